"""Corpus cleansing and normalisation jobs (DD-9, FLT-8/9/10, PRJ-2).

``cleanse`` builds one logical plan: cap -> record dedup -> per-field dedup
(exact, optionally MinHash) -> rule filters -> cap.  Exchanges happen only at
the dedup aggregates, the MinHash bucket aggregate and the caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, cleanse_text
from ..operators.dedup import dedup_column, dedup_records
from ..operators.minhash import drop_near_duplicates
from ..operators.sampling import cap_prefix


def cleanse_columns(df: DataFrame, text_fields: list[str], **rule_options) -> DataFrame:
    """FLT-8: every target field becomes its stripped text or null (other columns untouched)."""
    fields = set(text_fields)
    return df.select(*[cleanse_text(F.col(c), **rule_options).alias(c) if c in fields else F.col(c)
                       for c in df.columns])


def keep_any_field(df: DataFrame, text_fields: list[str]) -> DataFrame:
    """FLT-9: keep a record if any target field is non-null."""
    return df.where(F.coalesce(*[F.col(c) for c in text_fields]).isNotNull())


class RowAccount:
    """AGG-22: how many rows left each stage, observed in the passes that the job makes anyway."""

    def __init__(self):
        self._seen: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, stage: str) -> DataFrame:
        seen = Observation(f"{len(self._seen)}-{stage}")
        self._seen.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> list[tuple[int, str, int]]:
        """(number, stage, rows); waits for the action that runs the job."""
        return [(i, stage, seen.get["rows"]) for i, (stage, seen) in enumerate(self._seen)]


def cleanse(df: DataFrame, order_col: str, text_fields: list[str] | None = None,
            do_deduplicate: bool = True, do_rm_duplicated_by_minhash: bool = False,
            minhash_threshold: float = 0.95, minhash_num_perm: int = 128,
            minhash_bands: int | None = None, minhash_rows: int | None = None, minhash_verify: bool = False,
            do_rm_time_schedule: bool = True, rm_time_schedule_threshold: int = 3,
            do_rm_only_numeric: bool = True, do_rm_include_url_text: bool = True,
            do_rm_include_email_text: bool = True,
            max_use_samples: int | None = None, max_save_samples: int | None = None,
            account: RowAccount | None = None) -> DataFrame:
    """The cleansing job on one split; ``order_col`` is the record order (e.g. an id).

    With ``account`` every stage is counted where its rows pass by.
    """
    def counted(frame: DataFrame, stage: str) -> DataFrame:
        return frame if account is None else account.mark(frame, stage)

    order = [order_col]
    out = counted(cap_prefix(df, max_use_samples, order), "read")
    if do_deduplicate:
        key = list(text_fields) if text_fields else [c for c in df.columns if c != order_col]
        out = counted(dedup_records(out, key, order), "records")
    if text_fields:
        if do_deduplicate:
            for i, field in enumerate(text_fields):
                # after record dedup on this single field the exact pass can only
                # meet nulls, so it is skipped; the null drop below still applies
                if not (len(text_fields) == 1 and i == 0):
                    out = dedup_column(out, field, order)
                if do_rm_duplicated_by_minhash:
                    out = drop_near_duplicates(out, field, order_col, threshold=minhash_threshold,
                                               num_perm=minhash_num_perm, bands=minhash_bands,
                                               rows=minhash_rows, verify=minhash_verify)
                out = counted(out.where(F.col(field).isNotNull()), f"duplicates of {field}")
        out = cleanse_columns(out, text_fields, do_rm_time_schedule=do_rm_time_schedule,
                              rm_time_schedule_threshold=rm_time_schedule_threshold,
                              do_rm_only_numeric=do_rm_only_numeric,
                              do_rm_include_url_text=do_rm_include_url_text,
                              do_rm_include_email_text=do_rm_include_email_text)
        out = counted(keep_any_field(out, text_fields), "rules")
    return counted(cap_prefix(out, max_save_samples, order), "saved")


def normalize_fields(df: DataFrame, text_fields: list[str] | None = None) -> DataFrame:
    """PRJ-2 + STR-1/2: NFKC + whitespace collapse on string columns.

    None or empty ``text_fields`` means every string column; other types pass through.
    """
    wanted = set(text_fields or [])
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and (not wanted or f.name in wanted):
            out.append(clean_text(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
