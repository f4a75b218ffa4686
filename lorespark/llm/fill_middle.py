"""Fill-in-middle transformation of whole texts, with DataFrame functions only.

A text is an array of its code points; two cuts hashed from the document's id part it into prefix, middle and suffix, which are put together again
with sentinels in one of two arrangements. Every arrangement is restored exactly by parsing the sentinels: a text that holds one stays plain.

No row is moved. A row's code points stand in memory once (some 60 bytes each) while it is transformed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"
_UNIT = "(?s)."
#: Of 100 documents, those that are transformed and, of these, those whose suffix comes first.
RATE = 90
SPM_RATE = 20
_ADDED = ("fim_units", "fim_form", "fim_output", "prefix_chars", "middle_chars")


def _hash(i: int) -> F.Column:
    """The i-th 8-digit group (from 1) of the hash of the document's id, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` (doc_id, text and any further columns) with fim_units (code points), fim_form (plain, psm, spm), fim_output, and prefix_chars and middle_chars (null if plain).

    Null and empty texts and texts that hold a sentinel are plain; a null id is hashed as the empty string, repeated rows are transformed alike,
    an empty table stays empty. Columns of the added names in docs are replaced.
    """
    names = [c for c in docs.columns if c not in _ADDED]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.char_length(text).cast("bigint")
    plain = (n == 0) | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (_hash(3) % 100 >= rate)
    out = docs.select(*names, text.alias("__text"), n.alias("fim_units"), F.when(plain, F.lit("plain")).when(_hash(4) % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm")).alias("fim_form"))
    x, y = _hash(1) % (F.col("fim_units") + 1), _hash(2) % (F.col("fim_units") + 1)
    cut = F.col("fim_form") != "plain"
    out = out.withColumns({"__units": F.when(cut, F.regexp_extract_all("__text", F.lit(_UNIT), F.lit(0))), "__a": F.least(x, y).cast("int"), "__b": F.greatest(x, y).cast("int")})
    part = lambda start, size: F.array_join(F.slice("__units", start, size), "")
    a, b = F.col("__a"), F.col("__b")
    prefix, middle, suffix = part(F.lit(1), a), part(a + 1, b - a), part(b + 1, F.size("__units") - b)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("fim_form") == "psm", psm).when(F.col("fim_form") == "spm", spm).otherwise(F.col("__text"))
    return out.select(*names, "fim_units", "fim_form", output.alias("fim_output"), F.when(cut, a.cast("bigint")).alias("prefix_chars"), F.when(cut, (b - a).cast("bigint")).alias("middle_chars"))


def restore(form: str = "fim_form", output: str = "fim_output") -> F.Column:
    """The text that was transformed, from its form and output alone."""
    part = F.split(F.col(output), _SENTINEL, -1)
    return F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])).when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and hashes of the output and of the restored text, for every row of ``docs``."""
    out = transform(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars", F.sha2("fim_output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL for ``digests``; the restored text is the text itself."""
    return f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
g AS (SELECT *, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
