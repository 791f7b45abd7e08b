r"""Fill-in-the-middle transformation over relational units.

A text is cut into units by a pattern (code points, words, lines); whatever the
pattern leaves out is a unit a character, so that units tile the text. Two cut
requests a document name units by number; where they fall in the text is found
by relations:

1. matches are gathered ``BLOCK`` to a block, and ``posexplode`` makes each block
   a row; a window's running sum of the blocks' lengths gives where each begins;
2. the blocks that a request falls into are exploded once more, a row for each
   unit, and a second running sum gives where each unit ends;
3. requests join units by document and unit ordinal, and an aggregate for each
   document brings the offsets together;
4. ``substring`` takes prefix, middle and suffix, and the form puts them in order.

Rows are dealt once, by document; what follows (windows, join, aggregate) keeps
that deal, so only the texts are shuffled. Blocks make a text of n units n / 64
rows and at most 128 more, instead of n. No source, and no copies of a text,
share a key.

Defined cases: null and empty texts are plain and have no units; a null doc_id
counts as the empty string in the digest; repeated rows are separate documents
with equal results; an empty table gives an empty result; very long texts are
cut whole; texts with a sentinel in them stay plain; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a block.
BLOCK = 64
#: Bytes of text that a task cuts.
EACH = 16 << 20
UNITS = {"character": "(?s).", "word": r"\s*\S+", "line": r"[^\n]*\n|[^\n]+"}


def draws(doc_id: Column, seed: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers from the keyed digest of a document's id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def tiling(unit: str) -> str:
    """A unit's pattern, or any character that it does not match."""
    return unit if unit == UNITS["character"] else f"(?:{unit})|(?s:.)"


def gathered(unit: str, block: int) -> str:
    """As many units as a block holds, each as it would match by itself."""
    return f"(?s).{{1,{block}}}" if unit == UNITS["character"] else f"(?>{tiling(unit)}){{1,{block}}}+"


def offsets(rows: DataFrame, unit: str, block: int = BLOCK) -> DataFrame:
    """Rows (__row, __text, __cuts: array of numbers of units), dealt by __row -> (__row, __ends: map from each number to how many
    characters that many units have), for the rows that have a cut behind a unit."""
    # no filter here: Spark would push it below the deal, and the texts would be dealt twice
    wanted = F.when(F.exists("__cuts", lambda c: c > 0), F.regexp_extract_all("__text", F.lit(gathered(unit, block)), F.lit(0)))
    blocks = rows.select("__row", "__cuts", F.posexplode(wanted).alias("__b", "__part"))
    asked = F.exists("__cuts", lambda c: (c > 0) & (F.floor((c - 1) / block) == F.col("__b")))
    sized = blocks.select("__row", "__b", F.char_length("__part").cast("long").alias("__len"), F.when(asked, F.col("__part")).alias("__part"))
    before = Window.partitionBy("__row").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__base", F.coalesce(F.sum("__len").over(before), F.lit(0))).filter("__part IS NOT NULL")
    each = placed.select("__row", "__b", "__base", F.posexplode(F.regexp_extract_all("__part", F.lit(tiling(unit)), F.lit(0))).alias("__i", "__unit"))
    upto = Window.partitionBy("__row", "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.select("__row", (F.col("__b") * block + F.col("__i") + 1).cast("long").alias("__ordinal"), (F.col("__base") + F.sum(F.char_length("__unit")).over(upto)).alias("__end"))
    # by document, the units then being compared with its few requests: both sides keep the deal that they have
    requests = rows.select(F.col("__row").alias("__r"), "__cuts")
    met = ends.join(requests, (F.col("__row") == F.col("__r")) & F.array_contains("__cuts", F.col("__ordinal")))
    return met.groupBy("__row").agg(F.map_from_entries(F.collect_set(F.struct("__ordinal", "__end"))).alias("__ends"))  # two at most


RESULTS = ("n_units", "form", "prefix_chars", "middle_chars", "output")


@common.shielded
def infill(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = "character", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1:", block: int = BLOCK) -> DataFrame:
    """Documents with n_units, form (plain, psm or spm), prefix_chars, middle_chars and output; columns of these names are replaced.

    Of the documents that hold no sentinel and are not empty ``plain_percent`` stay as they are; of the others ``spm_percent`` have
    their suffix first. ``unit`` is a name in ``UNITS`` or a pattern that matches no empty string and looks at nothing beside it.
    """
    pattern = UNITS.get(unit, unit)
    kept, taken = [c for c in documents.columns if c.lower() not in RESULTS], {c.lower(): c for c in documents.columns}
    raw = documents.select(*common.columns(documents, but=RESULTS), F.monotonically_increasing_id().alias("__row"))
    if {doc_id.lower(), text.lower()} & set(RESULTS):
        raise ValueError(f"{taken[doc_id.lower()]} and {taken[text.lower()]} must not be named like a result")
    dealt = raw.repartition(common.partitions(documents, EACH), "__row")
    h1, h2, h3, h4 = draws(F.col(f"`{doc_id}`"), seed)
    whole = dealt.withColumns({"__text": F.coalesce(F.col(f"`{text}`"), F.lit("")), "__h1": h1, "__h2": h2, "__h3": h3, "__h4": h4})
    count = F.char_length("__text") if pattern == UNITS["character"] else F.regexp_count("__text", F.lit(tiling(pattern)))
    plain = (F.col("__text") == "") | (F.col("__h3") % 100 >= 100 - plain_percent)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("__text", F.lit(sentinel))
    n = F.col("__n")
    formed = whole.withColumns({"__n": count.cast("long"), "__form": F.when(plain, "plain").when(F.col("__h4") % 100 < spm_percent, "spm").otherwise("psm")})
    cuts = F.array(F.least(F.col("__h1") % (n + 1), F.col("__h2") % (n + 1)), F.greatest(F.col("__h1") % (n + 1), F.col("__h2") % (n + 1)))
    rows = formed.withColumn("__cuts", F.when(F.col("__form") != "plain", cuts).otherwise(F.array().cast("array<bigint>")))
    ends = offsets(rows, pattern, block).withColumnRenamed("__row", "__r")
    cut = rows.join(ends, F.col("__row") == F.col("__r"), "left")
    at = [F.when(F.col("__cuts")[k] == 0, F.lit(0)).otherwise(F.element_at("__ends", F.col("__cuts")[k]).cast("int")) for k in (0, 1)]
    cut = cut.withColumns({"__a": F.when(F.col("__form") != "plain", at[0]), "__m": F.when(F.col("__form") != "plain", at[1] - at[0])})
    part = lambda start, size: F.substring(F.col("__text"), start, size)
    prefix, middle, suffix = part(F.lit(1), F.col("__a")), part(F.col("__a") + 1, F.col("__m")), part(F.col("__a") + F.col("__m") + 1, F.lit(2147483647))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", spm).otherwise(F.col("__text"))
    found = {"n_units": n, "form": F.col("__form"), "prefix_chars": F.col("__a").cast("long"), "middle_chars": F.col("__m").cast("long"), "output": output}
    return cut.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], *[c.alias(name) for name, c in found.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no sentinel, so each is found where it stands first."""
    body = F.substring(output, 4, 2147483647)
    first = lambda s, mark: F.split_part(s, F.lit(mark), F.lit(1))
    second = lambda s, mark: F.split_part(s, F.lit(mark), F.lit(2))
    of_psm = F.concat(first(body, SUFFIX), second(second(body, SUFFIX), MIDDLE), first(second(body, SUFFIX), MIDDLE))
    of_spm = F.concat(first(second(body, PREFIX), MIDDLE), second(body, MIDDLE), first(body, PREFIX))
    return F.when(form == "psm", of_psm).when(form == "spm", of_spm).otherwise(output)


def op11_infill(documents: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    out = infill(documents.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
      least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def brute_force(doc_id: int | None, text: str | None) -> tuple[int, str, int | None, int | None, str, str]:
    """One document by slices, for tests."""
    t, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(s in t for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 90:
        return len(t), "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = PREFIX + t[:a] + SUFFIX + t[b:] + MIDDLE + t[a:b] if form == "psm" else SUFFIX + t[b:] + PREFIX + t[:a] + MIDDLE + t[a:b]
    return len(t), form, a, b - a, sha(out), sha(t)
