"""Benchmark decontamination with a distributed positional inverted index.

Benchmark texts become phrases: every run of ``width`` consecutive words (a shorter text is
one phrase). The corpus frequency of each phrase term is counted; a phrase with a term that
the corpus lacks cannot occur and is dropped at once. The rarest term of each remaining
phrase is its anchor.

The index stores the postings of the anchors: term, document, position, and the terms at the
``width - 1`` (plus slop) positions on either side. A phrase fetches the posting list of its
anchor; the list is intersected with the offset-adjusted positions of the next rarest terms
of the phrase, then of all of them. Because a posting carries its neighbours, each
intersection is a comparison at the posting and moves no data, and what a frequent word
would add to the index is never stored.

Documents are known by two hashes of their text (``text_key``): equal texts have equal
results, so copies meet in map-side aggregation, and no row numbers are needed.

The benchmark side is broadcast in blocks: terms are dealt by hash into as many blocks as
keep one block's phrases under ``BLOCK_BYTES``; each block is a pass over all documents.

Defined cases: a null or empty text has no words and no hits; an item without words has no
phrase; repeated items count once; an item without id can hit but is not counted; ties in
rarity go to the earlier offset; overlapping hits count each word once; an empty table on
either side gives no hits (documents stay); other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from headway.llm.common import SEPARATORS, ascii_lower, split_words, text_key
from headway.session import materialize

BLOCK_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def phrases(items: DataFrame, width: int = 13, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, items, pid): the distinct phrases and the sorted ids, as strings, of the items that hold them."""
    n = F.size("w")
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(n > 0)
    p = w.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))),
        lambda i: F.slice("w", i, F.lit(width)))).alias("phrase"))
    d = p.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return materialize(d.withColumn("pid", F.monotonically_increasing_id()), "phrases")


def _blocks(terms: DataFrame, size: Column) -> int:
    total = terms.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // BLOCK_BYTES))


def _positions(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """A row a word: term, pos (from 0) and the words of the whole text, not copied until a row is kept."""
    return docs.select(*more, words_of(F.col(text)).alias("w")).select(
        "*", F.posexplode("w").alias("pos", "term"))


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): occurrences of the given distinct ``term``s in all of ``docs``."""
    blocks = _blocks(terms, F.octet_length("term") + 64)
    at, out = _positions(docs, text).select("term"), None
    for b in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)
        n = at.join(F.broadcast(part), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def anchored(wanted: DataFrame, counts: DataFrame, rarest: int = 3) -> DataFrame:
    """Phrases that may occur: phrase, pid, anchor term, its offset, and the next rarest terms with theirs."""
    t = wanted.select("pid", "phrase", F.posexplode("phrase").alias("off", "term")).join(counts, "term", "left")
    order = Window.partitionBy("pid").orderBy(F.coalesce("n", F.lit(0)), "off")
    g = t.withColumn("rank", F.row_number().over(order)).groupBy("pid").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= rarest, F.struct("rank", "off", "term")))).alias("few"))
    first = F.get("few", 0)
    return g.where(F.col("least") > 0).join(wanted.select("pid", "phrase"), "pid").select(
        "pid", "phrase", first["term"].alias("anchor"), first["off"].alias("off"),
        F.transform(F.slice("few", 2, rarest), lambda x: F.struct(x["off"].alias("off"), x["term"].alias("term")))
        .alias("next"))


def build_index(docs: DataFrame, anchors: DataFrame, reach: int, text: str = "text") -> DataFrame:
    """Postings (term, k1, k2, pos, around, at) of the distinct ``anchors``, written to the shared folder.

    ``around`` has the words at pos - reach .. pos + reach and ``at`` the place of pos in it.
    """
    blocks = _blocks(anchors, F.octet_length("term") + 64)
    at, out = _positions(docs, text, *text_key(F.col(text))), None
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    for b in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)
        p = at.join(F.broadcast(part), "term").select(
            "term", "k1", "k2", "pos", F.slice("w", low + 1, F.col("pos") - low + 1 + reach).alias("around"),
            (F.col("pos") - low).alias("at"))
        out = p if out is None else out.unionByName(p)
    return materialize(out, "postings")


def _wanted_blocks(wanted: DataFrame):
    """Anchored phrases in blocks small enough to broadcast."""
    blocks = _blocks(wanted, F.octet_length(F.array_join("phrase", " ")) + 400)
    for b in range(blocks):
        yield F.broadcast(wanted.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b))


def phrase_matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct (k1, k2, start, length, pid): exact occurrences of anchored phrases."""
    begin, out = F.col("at") - F.col("off"), None
    for part in _wanted_blocks(wanted):
        m = index.join(part, F.col("term") == F.col("anchor"))
        m = m.where(begin >= 0)
        # The posting list intersected with the next rarest terms, then with the whole phrase.
        m = m.where(F.forall("next", lambda x: F.get("around", begin + x["off"]).eqNullSafe(x["term"])))
        m = m.where(F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase"))
        m = m.select("k1", "k2", (F.col("pos") - F.col("off")).alias("start"), F.size("phrase").alias("length"), "pid")
        out = m if out is None else out.unionByName(m)
    return out.distinct()


def proximity_matches(index: DataFrame, wanted: DataFrame, slop: int) -> DataFrame:
    """Distinct (k1, k2, pos, pid): all terms of a phrase, in any order, within its length plus ``slop`` words.

    ``index`` must reach ``width - 1 + slop`` words; ``pos`` is the anchor's position.
    """
    span, out = F.size("phrase") + slop, None
    near = lambda i: F.slice("around", i + 1, span)
    first = F.greatest(F.col("at") - span + 1, F.lit(0))
    for part in _wanted_blocks(wanted):
        m = index.join(part, F.col("term") == F.col("anchor"))
        m = m.where(F.exists(F.sequence(first, F.col("at")), lambda i: F.size(F.array_except("phrase", near(i))) == 0))
        m = m.select("k1", "k2", "pos", "pid")
        out = m if out is None else out.unionByName(m)
    return out.distinct()


def text_hits(docs: DataFrame, items: DataFrame, width: int = 13, text: str = "text") -> DataFrame:
    """(k1, k2, n_hit, items) of the texts of ``docs`` in which some phrase of ``items`` occurs."""
    wanted = phrases(items, width)
    terms = materialize(wanted.select(F.explode("phrase").alias("term")).distinct(), "terms")
    with_anchor = materialize(anchored(wanted, term_counts(docs, terms, text)), "anchored")
    index = build_index(docs, with_anchor.select(F.col("anchor").alias("term")).distinct(), width - 1, text)
    found = materialize(phrase_matches(index, with_anchor), "matches")
    ends = lambda x: x["start"] + x["length"]
    hits = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans")) \
        .select("k1", "k2", F.aggregate(
            "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, x: F.struct(F.greatest(a["end"], ends(x)).alias("end"), (a["n"] + F.greatest(
                ends(x) - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n")),
            lambda a: a["n"]).alias("n_hit"))
    held = found.select("k1", "k2", "pid").distinct().join(wanted.select("pid", "items"), "pid").select(
        "k1", "k2", F.explode("items").alias("item")).distinct().groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    return hits.join(held, ["k1", "k2"], "left")


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, keep: tuple[str, ...] = ("doc_id",),
                  text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with n_words, n_hit, n_items, items and contaminated."""
    none = F.array().cast("array<string>")
    d = docs.select(*keep, *text_key(F.col(text)), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    out = d.join(text_hits(docs, items, width, text), ["k1", "k2"], "left").withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", none)})
    return _decided(out).drop("k1", "k2")


def _decided(hits: DataFrame) -> DataFrame:
    return hits.withColumns({
        "n_items": F.size("items").cast("long"),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = 13, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Only texts with hits are looked at again for their length; the keys of contaminated
    texts are few, so Spark can broadcast them when it sees their size.
    """
    k1, k2 = text_key(F.col(text))
    hits = text_hits(docs, items, width, text).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    sized = docs.select(k1.alias("_a"), k2.alias("_b"), F.size(words_of(F.col(text))).alias("n_words"))
    bad = materialize(_decided(sized.join(hits, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2"))))
                      .where("contaminated").select("_k1", "_k2").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("_row"), k1.alias("_a"), k2.alias("_b"))
    return rows.join(bad, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")), "left_anti").select("_row.*")
