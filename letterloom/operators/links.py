"""Delivery links and routes (J3, F20, J15, T7 in batch form)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.dates import moment
from letterloom.functions.text import sanitize_html, strip_space

# What a recipient sees for an empty body, and the life of a link.
EMPTY_BODY = "<p>This email has no content.</p>"
LINK_DAYS = 30

# The route used when no configuration is enabled.
DIRECT_ROUTE = {"id": "direct-mx", "name": "Direct MX Delivery", "host": "", "port": 25,
                "region": "global"}


def is_expired(as_of) -> Column:
    return F.coalesce(F.col("expires_at") < moment(as_of), F.lit(False))


def link_state(links: DataFrame, as_of) -> DataFrame:
    """Links with their state: expired, viewed or open."""
    state = (F.when(is_expired(as_of), "expired").when(F.col("viewed"), "viewed")
             .otherwise("open"))
    return links.withColumn("state", state)


def open_links(tokens: DataFrame, links: DataFrame, mail: DataFrame, as_of) -> DataFrame:
    """What the holder of each valid token gets to see."""
    live = (links.filter(~is_expired(as_of))
            .join(tokens.select("token").distinct(), "token", "left_semi")
            .select("token", F.col("email_id").alias("id"), "expires_at"))
    body = F.col("body")
    shown = F.when(body.isNull() | (body == "null") | (strip_space(body) == ""),
                   EMPTY_BODY).otherwise(body)
    return live.join(mail.select("id", "subject", "from_name", "from_email", "to_emails",
                                 "date", "body"), "id").select(
        "token", "subject", "from_name", "from_email", "to_emails", "date",
        sanitize_html(shown).alias("body"), "expires_at")


def create_links(sends: DataFrame, mail: DataFrame, *, random_token: bool = True
                 ) -> DataFrame:
    """One link per send request (id, ts) of a known message.

    Tokens are random; with ``random_token=False`` they are a hash of the request,
    so that a replay yields the same link.
    """
    token = (F.concat_ws("-", F.uuid(), F.uuid()) if random_token
             else F.md5(F.concat_ws("|", "id", F.date_format("ts", "yyyyMMddHHmmssSSSSSS"))))
    days = F.make_interval(days=F.lit(LINK_DAYS))
    return (sends.join(mail.select("id", "to_emails"), "id")
            .select(F.concat(F.lit("link-"), "id").alias("id"), F.col("id").alias("email_id"),
                    F.col("to_emails").alias("recipient_email"), token.alias("token"),
                    F.lit(False).alias("viewed"),
                    F.lit(None).cast("timestamp_ntz").alias("viewed_at"),
                    (F.col("ts").cast("timestamp_ntz") + days).alias("expires_at"),
                    F.col("ts").cast("timestamp_ntz").alias("created_at")))


def assign_route(outgoing: DataFrame, configs: DataFrame) -> DataFrame:
    """Outgoing mail with the enabled route of lowest priority, or direct delivery.

    The route is one value, found once and sent to the tasks: no join.
    """
    names = list(DIRECT_ROUTE)
    route = F.struct(*names)
    best = (configs.filter(F.col("enabled") == 1)
            .agg(F.min_by(route, F.struct("priority", "id"))).scalar())
    direct = F.struct(*[F.lit(v).alias(k) for k, v in DIRECT_ROUTE.items()])
    chosen = outgoing.withColumn("_route", F.coalesce(best, direct))
    return chosen.select("id", *[F.col(f"_route.{n}").alias(f"route_{n}") for n in names])
