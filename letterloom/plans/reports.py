"""The screens of a mail client as bundles of DataFrames.

Each bundle names the columns it needs, so a columnar scan never touches the body
unless a part of the bundle reads it.  With ``keep=True`` the pruned columns are
persisted once for all parts (memory, then disk); call ``unpersist`` on
``bundle["mail"]`` when done.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from letterloom.operators import briefing as B
from letterloom.operators import commitments as C
from letterloom.operators import stats as S
from letterloom.operators import threads as T
from letterloom.operators import views as V
from letterloom.schema import DEFAULT_SELF

Bundle = dict[str, DataFrame]

ANALYTICS_COLUMNS = ["id", "thread_id", "from_email", "from_name", "date", "is_read",
                     "intent", "folder"]
CENTER_COLUMNS = ["id", "folder", "is_read", "is_starred", "is_important", "labels",
                  "snoozed_until", "from_email", "from_name", "subject", "intent", "body",
                  "date"]


def _base(mail: DataFrame, columns: list[str], keep: bool) -> DataFrame:
    if "has_question" in mail.columns:
        columns = [c for c in columns if c != "body"] + ["has_question"]
    pruned = mail.select(*columns)
    return pruned.persist(StorageLevel.MEMORY_AND_DISK) if keep else pruned


def analytics(mail: DataFrame, as_of, *, self_email: str = DEFAULT_SELF,
              keep: bool = False) -> Bundle:
    """Totals, correspondents, volume trend, overdue promises, intents."""
    base = _base(mail, ANALYTICS_COLUMNS, keep)
    volume = S.volume_by_day(base, as_of, self_email=self_email)
    return {
        "mail": base,
        "totals": S.totals(base, self_email=self_email),
        "top_correspondents": S.top_correspondents(base, self_email=self_email),
        "volume_by_day": volume,
        "volume_scaled": S.volume_scaled(volume),
        "overdue": C.overdue_count(base, as_of, self_email=self_email),
        "intents": S.intent_distribution(base),
        "intent_ranking": S.intent_ranking(base),
    }


def command_center(mail: DataFrame, as_of, *, self_email: str = DEFAULT_SELF,
                   keep: bool = False) -> Bundle:
    """Folder, view and label counts with the newest item of each view."""
    base = _base(mail, CENTER_COLUMNS, keep)
    return {
        "mail": base,
        "folders": S.folder_counts(base),
        "views": S.view_summary(base, as_of, self_email=self_email),
        "labels": S.label_counts(base),
    }


def conversation_list(mail: DataFrame, *, self_email: str = DEFAULT_SELF,
                      n: int = 20) -> Bundle:
    convs = T.conversations(mail, self_email=self_email)
    return {"conversations": T.recent_conversations(convs, n),
            "totals": T.conversation_totals(convs)}


def list_page(mail: DataFrame, as_of, *, limit: int = 50, offset: int = 0,
              **request) -> Bundle:
    """One page of a list for other programs, next to the number of matches."""
    rows = mail.filter(V.api_list_filter(as_of, **request))
    return {"page": V.api_projection(V.api_page(rows, limit, offset)),
            "total": V.page_total(rows)}


def daily_briefing(mail: DataFrame, as_of, *, self_email: str = DEFAULT_SELF) -> Bundle:
    sections = B.briefing_sections(mail, as_of, self_email=self_email)
    return {"sections": sections, "counts": B.briefing_counts(mail, self_email=self_email),
            "headline": B.briefing_headline(sections)}
