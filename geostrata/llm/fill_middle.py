"""Fill-in-middle transformation by escaped marker injection, with string functions only.

A text is cut into units (a word with the white space before it, or white space at the end). Two control
characters serve: DELIMITER ends a unit, ESCAPE makes room for it. Where the text itself has one of them, it
is escaped first, so DELIMITER stands for nothing else; both are no white space, so escaping moves no unit's
edge. One regexp_replace appends DELIMITER to every unit, the delimiters are counted, and substring_index
extracts the units before, between and behind two ranks. The parts then lose their delimiters, are unescaped
and assembled around the markers. A text is passed over some ten times, but nothing is exploded or shuffled.

What a document gets depends on the seed and its id alone: four unsigned numbers h1..h4 from the hex digits of
sha256("seed:id"). Prefix and middle end at the smaller and the larger of h1 and h2 modulo (units + 1);
h3 decides whether the text stays plain, h4 the order of the parts.

Nulls: a null text is empty; a null id counts as an empty one in the digest. Empty texts and texts that hold
a marker stay plain. Very long texts are worked on whole. Rows that repeat an id are cut at ranks from the same
numbers, each by its own units. An empty table gives no rows. Columns of the input beyond id and text aren't
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a text, and the markers of prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
DELIMITER, ESCAPE = "\x01", "\x02"
#: What stands for the two characters themselves in an escaped text.
ESCAPED = ((ESCAPE, ESCAPE + "e"), (DELIMITER, ESCAPE + "d"))


def escaped(text: Column) -> Column:
    """The text without DELIMITER."""
    for plain, other in ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(other))
    return text


def unescaped(part: Column) -> Column:
    """A part of a marked text as it was."""
    part = F.replace(part, F.lit(DELIMITER), F.lit(""))
    for plain, other in reversed(ESCAPED):
        part = F.replace(part, F.lit(other), F.lit(plain))
    return part


def seeded(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th unsigned number of a document, from 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def first_units(marked: Column, k: Column) -> Column:
    """The first k units of a marked text, with the delimiters between them."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), k.cast("int"))


def last_units(marked: Column, k: Column) -> Column:
    """What follows the k-th delimiter from the end."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), (-k).cast("int"))


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, percent_spm: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and the output.

    percent: how many of a hundred documents take a form other than plain; percent_spm: how many of these are spm.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = F.regexp_replace(escaped(F.col("text")), F.lit(UNIT), F.lit("$0" + DELIMITER))
    base = base.select("*", *[seeded(F.col("doc_id"), seed, k).alias(f"h{k}") for k in range(1, 5)], marked.alias("marked"))
    base = base.withColumn("n", F.regexp_count("marked", F.lit(DELIMITER)).cast("long"))
    stays = (F.col("text") == "") | (F.col("h3") % 100 >= percent)
    for m in (PREFIX, SUFFIX, MIDDLE):
        stays = stays | F.contains("text", F.lit(m))
    form = F.when(stays, "plain").when(F.col("h4") % 100 < percent_spm, "spm").otherwise("psm")
    r1, r2 = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    base = base.select("doc_id", "text", "n", form.alias("form"), F.least(r1, r2).alias("a"), F.greatest(r1, r2).alias("b"), "marked")
    cut = lambda part: F.when(F.col("form") != "plain", part)
    base = base.withColumn("front", cut(first_units(F.col("marked"), F.col("b"))))
    # the front has no delimiter at its end, so of its b units the last b - a follow the (b - a)-th from the end
    parts = {
        "prefix": cut(unescaped(first_units(F.col("marked"), F.col("a")))),
        "middle": cut(unescaped(F.when(F.col("a") == 0, F.col("front")).otherwise(last_units(F.col("front"), F.col("b") - F.col("a"))))),
        "suffix": cut(unescaped(F.when(F.col("b") == 0, F.col("marked")).otherwise(last_units(F.col("marked"), F.col("n") - F.col("b") + 1)))),
    }
    base = base.select("doc_id", "text", "n", "form", *[v.alias(k) for k, v in parts.items()])
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    return base.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a marker, and no marker begins within another, so they are found by search."""
    between = lambda a, b: F.call_function("substring_index", F.call_function("substring_index", output, F.lit(b), F.lit(1)), F.lit(a), F.lit(-1))
    middle = F.call_function("substring_index", output, F.lit(MIDDLE), F.lit(-1))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digests(out: DataFrame) -> DataFrame:
    """The output of transform() as digests: of itself and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def digests_sql(documents: str = "documents", seed: int = 42, percent: int = 50, percent_spm: int = 80) -> str:
    """The same rows in DuckDB SQL, by lists of units in place of a marked text."""
    h = lambda k: f"('0x' || substr(d, {8 * k - 7}, 8))::BIGINT"
    join = lambda lo, hi: f"coalesce(array_to_string(u[{lo}:{hi}], ''), '')"
    return f"""
    WITH t0 AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM {documents}),
    t1 AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM t0),
    t2 AS (SELECT *, len(u)::BIGINT AS n,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {h(3)} % 100 >= {percent} THEN 'plain'
                  WHEN {h(4)} % 100 < {percent_spm} THEN 'spm' ELSE 'psm' END AS form FROM t1),
    t3 AS (SELECT *, least({h(1)} % (n + 1), {h(2)} % (n + 1)) AS a, greatest({h(1)} % (n + 1), {h(2)} % (n + 1)) AS b FROM t2),
    t4 AS (SELECT doc_id, t, n, form, {join(1, 'a')} AS p, {join('a + 1', 'b')} AS m, {join('b + 1', 'n')} AS s FROM t3)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM t4"""
