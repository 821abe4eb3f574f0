"""Fill-in-the-middle forms by an escaped marker: one text becomes prefix, middle and suffix, in column expressions alone.

A mark that can't stand in the escaped text follows every unit. Counting marks gives the units, and the parts before,
between and behind two ranked marks are the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chordgrid.llm.common import text_of

#: What a text is cut into, left to right: runs of letters, and single other code points.
UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK, _ESCAPE = "\x01", "\x02"


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def marked(text: Column) -> Column:
    """``text`` with a mark behind each unit; the mark and the escape in the text itself become the escape and a digit, which stay one unit."""
    escaped = _replaced(text, (_ESCAPE, _ESCAPE + "0"), (_MARK, _ESCAPE + "1"))
    return F.regexp_replace(escaped, rf"\x02[01]|{UNIT}", "$0" + _MARK)


def plain(text: Column) -> Column:
    """What ``marked`` was made of."""
    return _replaced(text, (_MARK, ""), (_ESCAPE + "1", _MARK), (_ESCAPE + "0", _ESCAPE))


def _parts(text: Column, count: Column) -> Column:
    # the helper of the DataFrame API takes only a constant count
    return F.call_function("substring_index", text, F.lit(_MARK), count.cast("int"))


def _cut(text: Column, before: str | None, after: str | None) -> Column:
    """What stands between two strings that each stand once in ``text``; None for its beginning or end."""
    if before is not None:
        text = F.substring_index(text, before, -1)
    return text if after is None else F.substring_index(text, after, 1)


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of in its ``form``."""
    psm = F.concat(_cut(output, PREFIX, SUFFIX), _cut(output, MIDDLE, None), _cut(output, SUFFIX, MIDDLE))
    spm = F.concat(_cut(output, PREFIX, MIDDLE), _cut(output, MIDDLE, None), _cut(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 1, share: int = 90, spm_share: int = 20) -> DataFrame:
    """One row (doc_id, n, form, prefix, middle, suffix, output) for each row of ``df``.

    ``n`` counts units. Two ranks from 0 to n, by a hash of seed and doc_id, are the ends of prefix and middle. ``share``
    of a hundred texts are rearranged, ``spm_share`` of a hundred of those with the suffix first ("spm", else "psm");
    the rest, empty texts, and texts that hold one of the three sentinels are "plain": the output is the text and the
    pieces are null. Null texts count as empty, a null doc_id hashes as no digits and stays null, repeated rows give
    equal rows, whole texts of any length are cut, columns besides the two aren't read, so their names can't clash, and
    an empty table gives an empty result.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"), key.alias("key"))
    rows = rows.withColumn("marked", marked(F.col("text")))
    h = [F.conv(F.substring("key", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    n = F.octet_length("marked") - F.octet_length(_replaced(F.col("marked"), (_MARK, "")))
    rows = rows.select("doc_id", "text", "marked", n.cast("long").alias("n"), *[c.alias(f"h{i}") for i, c in enumerate(h, 1)])
    held = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held |= F.contains("text", F.lit(sentinel))
    form = F.when((F.col("n") == 0) | held | (F.col("h3") % 100 >= share), "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm")
    ends = [F.col(f"h{i}") % (F.col("n") + 1) for i in (1, 2)]
    rows = rows.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    pieces = {
        "prefix": _parts(F.col("marked"), F.col("a")),
        "middle": _parts(_parts(F.col("marked"), F.col("b")), F.col("a") - F.col("b")),
        # the mark behind the last unit leaves one more, empty part
        "suffix": _parts(F.col("marked"), F.col("b") - F.col("n") - 1),
    }
    rows = rows.select("doc_id", "text", "n", "form", *[F.when(F.col("form") != "plain", plain(piece)).alias(name) for name, piece in pieces.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))
