"""DataFrame operators of the mail model."""
