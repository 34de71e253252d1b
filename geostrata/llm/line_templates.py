"""Line dedup with a log-template tree of fixed depth, with DataFrame functions only.

A line goes down the tree by its number of words, then its three leading words, to a leaf. Case is folded
and runs of digits count as one digit, so numbers are variable everywhere. Lines are told apart in two steps:

* Whole lines: a folded line that is found in at least ``min_docs`` documents recurs. This needs a hash of the
  line only, and settles most lines.
* Merged lines: in leaves with several lines that differ, words of the others are compared by position (each whole
  line that recurs counts with its documents). The line whose words are the most frequent ones in their positions
  is the core of a template; lines that have its words in at least 7 of 10 positions are the template's instances, and
  positions where these differ are its variable fields. If they are in at least ``min_docs`` documents, it recurs.
  What is left in the leaf is merged again. After ``ROUNDS`` such rounds the lines that no recurring template has
  claimed are gone through until none of them has lines of ``min_docs`` documents around it, itself included, so a leaf
  gives as many templates with fields as it has.

A line of at least 300 bytes also falls into pieces, so that a passage within it is found whatever
stands around it: it is cut behind sentences, so cuts depend on the text next to them alone. A piece of at least 40 bytes recurs like a whole line. A text that holds the
character \\x01, which marks the cuts, has no pieces.

Lines and pieces that recur are dropped from all documents but the first (the smallest id) that has one of their
template, so that one copy of the content stays; of a whole line that recurs its own first copy does. A line that loses all its pieces stays as an empty one.

Counts are aggregations that are pre-aggregated before their shuffle, and joins go by hash with sides that
Spark can split, so a line of a third of all documents makes no hot task; words are compared for lines of leaves
with differing lines only. Blank lines are kept. Null and empty texts pass as they are. Rows that
repeat an id each count as a document, and the first id keeps its lines in each of them. Rows with a null id
count, and keep all their lines. Very long texts and lines are read whole. Lines end at \\n. Columns of the
input keep their values, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.columns import fresh
from geostrata.session import discard, materialize

#: A leaf's key has so many leading words; lines of fewer than LEAST_WORDS words have no leaf.
LEADING, LEAST_WORDS = 3, 8
#: An instance has so many in ten words of its template's core; rounds with one core a leaf; most cores of a leaf in each round after them.
CONSTANT_TENTHS, ROUNDS, CORES = 7, 2, 32
LONG_LINE, LEAST_PIECE = 300, 40
SPACE = " \t\r\f\x0b"
#: Behind what a long line may be cut, and the mark put there.
CUTS, MARK = (". ", "! ", "? "), "\x01"
MIN_DOCS = 3
#: A place in a text is a line's number, shifted by so many bits, plus the number of a piece, or 0 for the line.
SHIFT = 32
#: Bits of a filter over keys: 64 a row of a table of at most 2^18 rows, so its broadcast is bounded.
FILTER_BITS = 24


def folded(text: Column) -> Column:
    """Lower case, each run of digits as one 0."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def marked(text: Column, of: Column | None = None) -> Column:
    """A text with marks where its long lines may be cut; a text that has the mark gets none, and other characters for its own.

    of: where text is folded, the text it comes from. It has the mark where the folded one has, and asking it folds nothing.
    """
    cut = text
    for end in CUTS:
        cut = F.replace(cut, F.lit(end), F.lit(end + MARK))
    return F.when(F.contains(text if of is None else of, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit("\x02"))).otherwise(cut)


def spaced(text: Column) -> Column:
    """Tabs as spaces; after marking, so that a text is marked in the same places before and after folding."""
    return F.replace(text, F.lit("\t"), F.lit(" "))


def words(line: Column) -> Column:
    """The words of a trimmed, folded line: what single spaces part."""
    return F.split(line, " ")


def n_words(line: Column) -> Column:
    """The number of words of a trimmed, folded line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """dkey (a hash of doc_id and text), keep, line (its number) and l (folded and marked) of all lines."""
    # null texts go before folding: a filter on what is folded would fold every text once more
    text = F.col("text")
    base = docs.where(text.isNotNull()).select(*keep, F.xxhash64("doc_id", "text").alias("dkey"), spaced(marked(folded(text), text)).alias("f"))
    return base.select("dkey", *keep, F.posexplode(F.split("f", "\n")).alias("line", "l"))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, dkey, rid (of the row), place, whole (hash of a line or piece) and leaf (of lines) of all lines and pieces that aren't blank."""
    lines = lines_of(docs.withColumn("rid", F.monotonically_increasing_id()), "doc_id", "rid")
    cut = (F.octet_length("l") >= LONG_LINE) & F.contains("l", F.lit(MARK))
    parts = F.when(cut, F.concat(F.array("l"), F.split("l", MARK))).otherwise(F.array("l"))
    each = lines.select("dkey", "doc_id", "rid", "line", F.posexplode(parts).alias("piece", "l"))
    each = each.withColumn("l", trimmed(F.col("l")))
    each = each.where(F.octet_length("l") >= F.when(F.col("piece") == 0, 1).otherwise(LEAST_PIECE))
    n = F.when(F.col("piece") == 0, n_words(F.col("l")))
    lead = F.substring_index("l", " ", LEADING)
    each = each.select("doc_id", "dkey", "rid", (F.shiftleft(F.col("line").cast("long"), SHIFT) + F.col("piece")).alias("place"), F.xxhash64(F.col("piece") == 0, "l").alias("whole"), n.alias("n"), lead.alias("lead"))
    return each.select("doc_id", "dkey", "rid", "place", "whole", F.when(F.col("n") >= LEAST_WORDS, F.xxhash64("n", "lead")).alias("leaf"))


def spelled_out(kinds: DataFrame) -> DataFrame:
    """kinds (leaf, kind, words and more) spread by position, with hashes of words."""
    more = [c for c in kinds.columns if c not in ("leaf", "kind", "words")]
    return kinds.select("leaf", "kind", *more, F.posexplode("words").alias("pos", "word")).withColumn("word", F.xxhash64("word"))


def fits(words: Column, core: Column) -> Column:
    """Whether a line has the core's words in so many places."""
    same = F.size(F.filter(F.zip_with(words, core, lambda a, b: a == b), lambda x: x))
    return same * 10 >= F.size(words) * CONSTANT_TENTHS


def merged(items: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One template with fields a leaf: dkey and place of lines to drop, the items that aren't its instances, and the instances of templates that don't recur.

    items: leaf, dkey, place (null for a whole line that recurs), weight (documents), first (smallest id), words.
    """
    # words of a kind of line stay in one row; what is spread by position has their hash
    kinds = items.withColumn("kind", F.xxhash64("words")).groupBy("leaf", "kind").agg(F.min("words").alias("words"), F.sum("weight").alias("n"))
    each = spelled_out(kinds.select("leaf", "kind", "n", "words"))
    counts = each.groupBy("leaf", "pos", "word").agg(F.sum("n").alias("count"))
    scores = each.join(counts, ["leaf", "pos", "word"]).groupBy("leaf", "kind").agg(F.sum("count").alias("score"))
    best = kinds.join(scores, ["leaf", "kind"]).groupBy("leaf").agg(F.max(F.struct("score", F.col("words").alias("core"))).alias("best"))
    core = best.select("leaf", "best.core")
    told = materialize(items.join(core, "leaf").withColumn("fits", fits(F.col("words"), F.col("core"))).drop("core"), "line-merged")
    of_doc = told.where("fits").groupBy("leaf", "dkey").agg(F.max("weight").alias("weight"), F.min("first").alias("first"))
    found = of_doc.groupBy("leaf").agg(F.sum("weight").alias("n"), F.min("first").alias("first_doc"))
    found = materialize(found, "line-found")
    gone = told.where(F.col("fits") & F.col("place").isNotNull()).join(found.where(F.col("n") >= min_docs), "leaf").where(F.col("first") != F.col("first_doc"))
    unclaimed = told.where("fits").join(found.where(F.col("n") < min_docs).select("leaf"), "leaf", "left_semi")
    return gone.select("dkey", "place"), told.where(~F.col("fits")).drop("fits"), unclaimed.drop("fits")


def most_around(counts: Column) -> Column:
    """At most so many lines can fit a core, given how many have its word at each place.

    A line that fits shares m of n places, so all but j of these are among any n - j: the sum over the n - j places
    with the least counts is at least m - j times the number of lines that fit. The least of these bounds is taken.
    """
    spare = F.floor(F.size(counts) * (10 - CONSTANT_TENTHS) / F.lit(10)).cast("int")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(1e18).alias("least"))

    def add(a: Column, x: Column) -> Column:
        total, k = a["sum"] + x, a["k"] + 1
        return F.struct(total.alias("sum"), k.alias("k"), F.when(k > spare, F.least(a["least"], total / (k - spare))).otherwise(a["least"]).alias("least"))

    return F.aggregate(F.array_sort(counts), start, add, lambda a: a["least"])


def cores_of(pool: DataFrame, min_docs: int) -> DataFrame:
    """leaf, core (its kind), core_words and rank of lines that may have lines of min_docs documents around them, some of which can be dropped: at most CORES a leaf."""
    kinds = pool.groupBy("leaf", "kind").agg(F.min("words").alias("words"), F.sum("weight").alias("n"), F.sum(F.col("place").isNotNull().cast("long")).alias("open"), F.max("tried").alias("tried"))
    each = spelled_out(kinds)
    counts = each.groupBy("leaf", "pos", "word").agg(F.sum("n").alias("all_n"), F.sum("open").alias("all_open"))
    bounds = each.join(counts, ["leaf", "pos", "word"]).groupBy("leaf", "kind").agg(
        F.sum("all_n").alias("score"), F.collect_list(F.col("all_n").cast("double")).alias("ns"), F.collect_list(F.col("all_open").cast("double")).alias("opens"), F.max("tried").alias("tried")
    )
    may = bounds.where(~F.col("tried") & (most_around(F.col("ns")) > min_docs - 1e-6) & (most_around(F.col("opens")) > 1 - 1e-6)).select("leaf", "kind", "score")
    may = materialize(kinds.select("leaf", "kind", "words").join(may, ["leaf", "kind"]), "line-cores")
    # the best of those that share a word at a place leads there; near copies of a better one lead in their fields only
    places = spelled_out(may)
    leads = places.groupBy("leaf", "pos", "word").agg(F.max(F.struct("score", "kind")).alias("best")).groupBy("leaf", F.col("best.kind").alias("kind")).agg(F.count(F.lit(1)).alias("places"))
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("places"), F.desc("score"), "kind"))
    return may.join(leads, ["leaf", "kind"]).withColumn("rank", rank).where(F.col("rank") <= CORES).select("leaf", F.col("kind").alias("core"), F.col("words").alias("core_words"), "rank")


def merged_whole(items: DataFrame, min_docs: int) -> list[DataFrame]:
    """dkey and place of lines to drop, of all templates that are left in the items, however many a leaf has.

    In each round every leaf tries up to CORES of its lines as cores. A core without lines of min_docs documents
    around it is never tried again, as lines only leave. Of the others the first takes all lines that fit it, so
    each round settles at least one core of each leaf, and the rounds end when none is left.
    """
    gone: list[DataFrame] = []
    pool = items.select("*", F.xxhash64("words").alias("kind"), F.lit(False).alias("tried"))
    worth = lambda rows: rows.join(rows.groupBy("leaf").agg(F.sum("weight").alias("all"), F.count("place").alias("open")).where((F.col("all") >= min_docs) & (F.col("open") > 0)).select("leaf"), "leaf", "left_semi")
    pool = materialize(worth(pool).withColumn("item", F.monotonically_increasing_id()), "line-pool")
    while not pool.isEmpty():
        cores = materialize(cores_of(pool, min_docs), "line-tried")
        if cores.isEmpty():
            break
        pairs = pool.join(cores, "leaf").where(fits(F.col("words"), F.col("core_words")))
        pairs = materialize(pairs.select("leaf", "core", "rank", "item", "dkey", "place", "weight", "first"), "line-fits")

        def documents(rows: DataFrame) -> DataFrame:
            of_doc = rows.groupBy("leaf", "core", "dkey").agg(F.max("weight").alias("weight"), F.min("first").alias("first"), F.count("place").alias("open"))
            return of_doc.groupBy("leaf", "core").agg(F.sum("weight").alias("n"), F.min("first").alias("first_doc"), F.sum("open").alias("open"))

        enough = (F.col("n") >= min_docs) & (F.col("open") > 0)
        around = materialize(documents(pairs).withColumn("enough", enough), "line-around")
        first = pairs.join(around.where("enough").select("leaf", "core"), ["leaf", "core"]).groupBy("leaf", "item").agg(F.min(F.struct("rank", "core", "dkey", "place", "weight", "first")).alias("of"))
        first = materialize(first.select("leaf", "item", "of.*"), "line-first")
        found = materialize(documents(first).where(enough), "line-found")
        claimed = first.join(found.select("leaf", "core", "first_doc"), ["leaf", "core"])
        gone.append(claimed.where(F.col("place").isNotNull() & (F.col("first") != F.col("first_doc"))).select("dkey", "place"))
        # cores are done that have too few lines around them, and those that were found; a leaf without cores is done as well
        done = around.where(~F.col("enough")).select("leaf", "core").unionByName(found.select("leaf", "core")).select("leaf", F.col("core").alias("kind"), F.lit(True).alias("now"))
        left = pool.join(cores.select("leaf").distinct(), "leaf", "left_semi").join(claimed.select("leaf", "item"), ["leaf", "item"], "left_anti")
        left = left.join(done, ["leaf", "kind"], "left").withColumn("tried", F.col("tried") | F.coalesce("now", F.lit(False)))
        rest = materialize(worth(left.select(*pool.columns)), "line-pool")
        for old in (pool, cores, pairs, around):
            discard(old)
        pool = rest
    return gone


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, hit: str) -> DataFrame:
    """rows with hit, whether their key may be among keys (key): false positives only, so an exact join follows.

    It keeps texts that nothing is asked of from the shuffle. The more keys, the more rows pass, at the cost of time only.
    """
    word, bits = fresh(rows, "word"), fresh(rows, "bits")
    at, bit = F.shiftright(F.col(key).bitwiseAND((1 << FILTER_BITS) - 1), 6), F.expr(f"shiftleft(1L, cast(`{key}` & 63L as int))")
    words = keys.groupBy(at.alias(word)).agg(F.bit_or(bit).alias(bits))
    out = rows.withColumn(word, at).join(F.broadcast(words), word, "left")
    return out.withColumn(hit, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))).drop(word, bits)


def in_leaves(docs: DataFrame, lined: DataFrame, recurring: DataFrame, min_docs: int) -> DataFrame:
    """The items of merged(): lines that don't recur whole, and one of each kind of those that do, in leaves with lines that differ."""
    leaves = lined.where(F.col("leaf").isNotNull()).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    leaves = materialize(leaves.where((F.col("n") >= min_docs) & (F.col("a") != F.col("b"))).select("leaf"), "line-leaves")
    here = lined.join(leaves, "leaf")
    # equal lines of one document, and copies of it, are one row: at most one a kind, document and place
    kinds = here.groupBy("leaf", "whole").agg(F.min(F.struct("dkey", "place")).alias("at")).join(recurring, "whole")
    known = kinds.select("leaf", F.col("at.dkey").alias("dkey"), F.col("at.place").alias("place"), F.col("n").alias("weight"), F.col("first_doc").alias("first"), F.lit(True).alias("recurs"))
    others = here.join(recurring.select("whole").hint("merge"), "whole", "left_anti").groupBy("leaf", "dkey", "place").agg(F.count_distinct("rid").alias("weight"), F.min("doc_id").alias("first"))
    wanted = materialize(known.unionByName(others.withColumn("recurs", F.lit(False))), "line-wanted")
    asked = wanted.select("dkey").distinct()
    texts = maybe_in(docs.withColumn("dkey", F.xxhash64("doc_id", "text")), "dkey", asked, "hit").where("hit")
    at = F.xxhash64("dkey", "place").alias("at")
    lines = texts.select("dkey", F.posexplode(F.split("text", "\n")).alias("line", "l")).select("dkey", F.shiftleft(F.col("line").cast("long"), SHIFT).alias("place"), "l")
    lines = maybe_in(lines.select("*", at), "at", wanted.select(at), "hit").where("hit").select("dkey", "place", trimmed(spaced(F.replace(folded(F.col("l")), F.lit(MARK), F.lit("\x02")))).alias("l"))
    items = lines.join(wanted, ["dkey", "place"]).groupBy("leaf", "dkey", "place", "weight", "first", "recurs").agg(F.min("l").alias("l"))
    return items.select("leaf", "dkey", F.when(~F.col("recurs"), F.col("place")).alias("place"), "weight", "first", words(F.col("l")).alias("words"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines and pieces at the places that are gone, by hash-based set differences."""
    line_of = lambda p: F.shiftright(p, SHIFT).cast("int")
    piece_of = lambda p: (p % (1 << SHIFT)).cast("int")

    def build(segs: Column) -> Column:
        all_lines = F.transform(F.sequence(F.lit(0), F.size(segs) - 1), lambda i: F.shiftleft(i.cast("long"), SHIFT))
        lines = F.array_except(all_lines, gone)
        # the place of a line that stays stands for the end of the line before
        places = F.flatten(F.transform(lines, lambda p: F.transform(F.sequence(F.lit(0), F.size(F.get(segs, line_of(p)))), lambda k: p + k)))
        parts = F.transform(F.array_except(places, gone), lambda p: F.when(piece_of(p) == 0, "\n").otherwise(F.get(F.get(segs, line_of(p)), piece_of(p) - 1)))
        return F.substr(F.array_join(parts, ""), F.lit(2))

    def whole_lines(lines: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.shiftleft(i.cast("long"), SHIFT))
        return F.array_join(F.transform(F.array_except(places, gone), lambda p: F.get(lines, line_of(p))), "\n")

    # where the text has the mark itself, no line is cut; a line that isn't cut has one segment
    cut = lambda f, o: F.when((F.octet_length(f) >= LONG_LINE) & F.contains(f, F.lit(MARK)), F.split(o, MARK)).otherwise(F.array(F.replace(o, F.lit(MARK), F.lit(""))))
    segs = F.when(F.contains(text, F.lit(MARK)), F.transform(F.split(text, "\n"), lambda o: F.array(o))).otherwise(F.zip_with(F.split(marked(folded(text), text), "\n"), F.split(marked(text), "\n"), cut))
    return F.when(F.exists(gone, lambda p: piece_of(p) != 0), let(segs, build)).otherwise(let(F.split(text, "\n"), whole_lines))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, n_lines, n_dropped (lines), n_cut (pieces, also those in such lines) and the text without them."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return clean(base, min_docs, ("n_lines", "n_dropped", "n_cut")).select("doc_id", "n_lines", "n_dropped", "n_cut", "text")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, names: tuple[str, str, str] = ("n_lines", "n_dropped", "n_cut")) -> DataFrame:
    """docs with all columns, text without the dropped lines and pieces, and three counts under these names, which docs must not have."""
    base = docs.select("doc_id", "text")
    lined = materialize(hashed_lines(base), "line-hashes")
    recurring = lined.groupBy("whole").agg(F.count_distinct("rid").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_docs)
    # on its own, so that Spark can split a line of very many documents in the join; it grows with the corpus, so it is never broadcast
    recurring = materialize(recurring, "line-recurring")
    gone = [lined.join(recurring.hint("merge"), "whole").where(F.col("doc_id") != F.col("first_doc")).select("dkey", "place")]
    items = materialize(in_leaves(base, lined, recurring, min_docs), "line-items")
    unclaimed = []
    for _ in range(ROUNDS):
        if items.isEmpty():
            break
        found, items, few = merged(items, min_docs)
        gone.append(found)
        unclaimed.append(few)
    for few in unclaimed:
        items = items.unionByName(few)
    gone += merged_whole(items, min_docs)
    key, all_gone = fresh(docs, "key"), fresh(docs, "gone")
    dropped = gone[0]
    for more in gone[1:]:
        dropped = dropped.unionByName(more)
    dropped = materialize(dropped.groupBy(F.col("dkey").alias(key)).agg(F.collect_set("place").alias(all_gone)), "line-dropped")
    # texts that lose nothing stay where they are
    hit = fresh(docs, "hit")
    out = maybe_in(docs.withColumn(key, F.xxhash64("doc_id", "text")), key, dropped.select(key), hit)
    stays = out.where(~F.col(hit)).withColumn(all_gone, F.lit(None).cast("array<bigint>"))
    out = out.where(hit).join(dropped, key, "left").select(*stays.columns).unionAll(stays)
    pieces = F.filter(F.col(all_gone), lambda p: p % (1 << SHIFT) != 0)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    out = out.withColumn(names[0], F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    out = out.withColumn(names[1], n(F.col(all_gone)) - n(pieces)).withColumn(names[2], n(pieces))
    out = out.withColumn("text", F.when(F.col(all_gone).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(all_gone))))
    return out.select(*docs.columns, *names)


def drop_recurring_sql(documents: str = "documents", min_docs: int = MIN_DOCS) -> str:
    """The same rows in DuckDB SQL, with lines and words in place of their hashes, where ROUNDS rounds leave no template in any leaf."""
    space = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"
    rounds = ""
    for k in range(ROUNDS):
        rounds += f"""
    e{k} AS (SELECT leaf, weight, w, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM i{k}),
    c{k} AS (SELECT leaf, pos, word, sum(weight) AS n FROM e{k} GROUP BY ALL),
    s{k} AS (SELECT leaf, w, sum(n) AS score FROM (SELECT DISTINCT leaf, w, pos, word FROM e{k}) JOIN c{k} USING (leaf, pos, word) GROUP BY ALL),
    r{k} AS (SELECT leaf, arg_max(w, struct_pack(score, w)) AS core FROM s{k} GROUP BY ALL),
    f{k} AS (SELECT i.*, 10 * len(list_filter(list_zip(w, core), lambda x: x[1] = x[2])) >= {CONSTANT_TENTHS} * len(w) AS fits FROM i{k} i JOIN r{k} USING (leaf)),
    d{k} AS (SELECT leaf, doc_id, max(weight) AS weight, min(first) AS first FROM f{k} WHERE fits GROUP BY ALL),
    t{k} AS (SELECT leaf, min(first) AS first_doc FROM d{k} GROUP BY ALL HAVING sum(weight) >= {min_docs}),
    g{k} AS (SELECT doc_id, line, 0 AS piece FROM f{k} JOIN t{k} USING (leaf) WHERE fits AND NOT recurs AND first <> first_doc),
    i{k + 1} AS (SELECT * EXCLUDE (fits) FROM f{k} WHERE NOT fits),"""
    fold = "regexp_replace(lower(text), '[0-9]+', '0', 'g')"

    def mark(x: str) -> str:
        cut = x
        for end in CUTS:
            cut = f"replace({cut}, '{end}', '{end}' || chr(1))"
        return f"CASE WHEN contains({x}, chr(1)) THEN replace({x}, chr(1), chr(2)) ELSE {cut} END"

    return f"""
    WITH raw AS (SELECT doc_id, string_split(replace({mark(fold)}, chr(9), ' '), chr(10)) AS fl, string_split({mark('text')}, chr(10)) AS ol, string_split(text, chr(10)) AS tl FROM {documents} WHERE text IS NOT NULL),
    ln AS (SELECT doc_id, unnest(fl) AS f, unnest(ol) AS o, unnest(tl) AS t, unnest(range(0, len(fl))) AS line FROM raw),
    sg AS (SELECT doc_id, line, 0 AS piece, trim(f, {space}) AS l FROM ln
           UNION ALL SELECT doc_id, line, unnest(range(1, len(string_split(f, chr(1))) + 1)), trim(unnest(string_split(f, chr(1))), {space}) FROM ln WHERE strlen(f) >= {LONG_LINE} AND contains(f, chr(1))),
    s AS (SELECT *, CASE WHEN piece = 0 THEN string_split(replace(l, chr(1), ''), ' ') END AS w FROM sg WHERE strlen(l) >= CASE WHEN piece = 0 THEN 1 ELSE {LEAST_PIECE} END),
    h AS (SELECT *, CASE WHEN len(w) >= {LEAST_WORDS} THEN len(w) || ':' || array_to_string(string_split(l, ' ')[1:{LEADING}], ' ') END AS leaf FROM s),
    rec AS (SELECT piece = 0 AS is_line, l, count(DISTINCT doc_id) AS n, min(doc_id) AS first_doc FROM h GROUP BY ALL HAVING count(DISTINCT doc_id) >= {min_docs}),
    lf AS (SELECT leaf FROM h WHERE leaf IS NOT NULL GROUP BY leaf HAVING count(*) >= {min_docs} AND count(DISTINCT l) > 1),
    hl AS (SELECT h.*, rec.n, rec.first_doc FROM h JOIN lf USING (leaf) LEFT JOIN rec ON rec.is_line AND h.l = rec.l),
    i0 AS (SELECT leaf, min(doc_id) AS doc_id, NULL::BIGINT AS line, n AS weight, first_doc AS first, any_value(w) AS w, true AS recurs FROM hl WHERE n IS NOT NULL GROUP BY leaf, l, n, first_doc
           UNION ALL SELECT leaf, doc_id, line, 1, doc_id, w, false FROM hl WHERE n IS NULL),{rounds}
    gone AS (SELECT h.doc_id, h.line, h.piece FROM h JOIN rec ON (h.piece = 0) = rec.is_line AND h.l = rec.l WHERE doc_id <> first_doc{"".join(f" UNION SELECT * FROM g{k}" for k in range(ROUNDS))}),
    sp AS (SELECT doc_id, line, unnest(range(1, len(ps) + 1)) AS piece, unnest(ps) AS o FROM (SELECT doc_id, line, CASE WHEN strlen(f) >= {LONG_LINE} AND contains(f, chr(1)) THEN string_split(o, chr(1)) ELSE [t] END AS ps FROM ln)),
    mended AS (SELECT sp.doc_id, sp.line, coalesce(string_agg(o, '' ORDER BY sp.piece) FILTER (g.piece IS NULL), '') AS l FROM sp LEFT JOIN gone g ON sp.doc_id = g.doc_id AND sp.line = g.line AND sp.piece = g.piece GROUP BY 1, 2),
    kept AS (SELECT m.doc_id, string_agg(m.l, chr(10) ORDER BY m.line) FILTER (g.line IS NULL) AS text FROM mended m LEFT JOIN gone g ON m.doc_id = g.doc_id AND m.line = g.line AND g.piece = 0 GROUP BY m.doc_id),
    n AS (SELECT doc_id, count(*) FILTER (piece = 0) AS n_dropped, count(*) FILTER (piece > 0) AS n_cut FROM gone GROUP BY doc_id)
    SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(n_cut, 0)::BIGINT AS n_cut,
      CASE WHEN d.text IS NULL THEN NULL WHEN coalesce(n_dropped, 0) + coalesce(n_cut, 0) = 0 THEN d.text ELSE coalesce(k.text, '') END AS text
    FROM {documents} d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""
