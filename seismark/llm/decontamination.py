"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

For each window of benchmark words, the rarest of its terms in the training corpus are chosen. The postings of these terms
(term, document, positions) are stored as a table; windows are looked up from their rarest term on: the position lists,
shifted by each term's offset in the window, are intersected, and what is left is compared word by word with the document.
Proximity matches come from the same lists: all chosen terms within a stretch that is a little longer than the window.

The benchmark is a stated query set. Its chosen terms and windows are joined in blocks of at most ``BLOCK`` windows, so what
is broadcast has a bound and a larger benchmark means more blocks.

Defined results: null or blank texts have no words; items without words have no windows; items that are rows of the same id
count together; a null item id is no item; rows that repeat a document are judged alike; texts under one id are judged each
on its own; other columns are ignored; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seismark.llm.common import rows_keyed, written
from seismark.llm.url_filter import LOWER, UPPER

WIDTH, DEPTH, SLACK, BLOCK = 10, 3, 5, 50_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def keys() -> list[Column]:
    """What tells documents apart: the id (null: before all others) and the text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("kid"), F.xxhash64("text").alias("tv")]


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters and all characters beyond ASCII; A-Z in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def keyed_words(docs: DataFrame) -> DataFrame:
    return docs.select(*keys(), words(F.col("text")).alias("words"))


def window_id(terms: Column) -> Column:
    """128 bits of a window's words; windows are compared by it."""
    return F.unhex(F.md5(F.array_join(terms, " ").cast("binary")))


def windows(benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Different windows (wid, terms) and the items they come from (wid, item_id)."""
    w = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(width)).alias("terms"))
    each = each.select("item_id", window_id(F.col("terms")).alias("wid"), "terms")
    return each.groupBy("wid").agg(F.first("terms").alias("terms")), each.select("wid", "item_id").distinct()


def term_counts(docs: DataFrame) -> DataFrame:
    """How often every term occurs in the corpus; counted in each task before the shuffle."""
    return docs.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def choose_terms(wins: DataFrame, counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """wid, length, probes: the rarest terms of each window with their offsets, rarest first. A window with a term that the
    corpus lacks cannot occur and is left out."""
    terms = wins.select("wid", "terms", F.posexplode("terms").alias("offset", "term"))
    vocabulary = terms.select("term").distinct()
    known = vocabulary.join(counts, "term").select("term", "n")
    rank = terms.join(known, "term", "left").groupBy("wid").agg(F.count("*").cast("int").alias("length"), F.min(F.col("n").isNotNull()).alias("whole"),
                                                                F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("by_n"))
    return rank.where("whole").select("wid", "length", F.slice("by_n", 1, depth).alias("probes"))


def index(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The stored postings of the chosen terms: term, kid, tv, positions (ascending, from 0)."""
    terms = chosen.select(F.explode("probes.term").alias("term")).distinct()  # at most DEPTH * BLOCK terms
    each = docs.select("kid", "tv", F.posexplode("words").alias("pos", "term")).join(F.broadcast(terms), "term")
    return written(each.groupBy("term", "kid", "tv").agg(F.sort_array(F.collect_set("pos")).alias("positions")), "postings")


def probe(chosen: DataFrame, i: int) -> DataFrame:
    """wid, length, term, offset of the windows' probe number i; at most BLOCK rows."""
    return F.broadcast(chosen.where(F.size("probes") > i).select("wid", "length", F.col("probes")[i]["term"].alias("term"), F.col("probes")[i]["offset"].alias("offset")))


def short_of(chosen: DataFrame, i: int) -> DataFrame:
    return F.broadcast(chosen.where(F.size("probes") <= i).select("wid"))


def phrase_starts(postings: DataFrame, chosen: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kid, tv, wid, starts: where all chosen terms of a window stand at their offsets."""
    shifted = F.transform("positions", lambda p: p - F.col("offset"))
    found = postings.join(probe(chosen, 0), "term").select("kid", "tv", "wid", F.filter(shifted, lambda s: s >= 0).alias("starts")).where(F.size("starts") > 0)
    for i in range(1, depth):
        more = found.join(probe(chosen, i), "wid").join(postings, ["kid", "tv", "term"]).select("kid", "tv", "wid", F.array_intersect("starts", shifted).alias("starts")).where(F.size("starts") > 0)
        found = more.unionByName(found.join(short_of(chosen, i), "wid", "left_semi"))
    return found


def near_windows(postings: DataFrame, chosen: DataFrame, depth: int = DEPTH, slack: int = SLACK) -> DataFrame:
    """kid, tv, wid: documents where all chosen terms of a window stand within window length + slack words, in any order."""
    reach = F.col("length") + slack
    found = postings.join(probe(chosen, 0), "term").select("kid", "tv", "wid", F.transform("positions", lambda p: F.struct(p.alias("lo"), p.alias("hi"))).alias("spans"))
    for i in range(1, depth):
        grown = F.flatten(F.transform("spans", lambda s: F.transform(
            F.filter("positions", lambda p: (F.greatest(s["hi"], p) - F.least(s["lo"], p)) < reach), lambda p: F.struct(F.least(s["lo"], p).alias("lo"), F.greatest(s["hi"], p).alias("hi")))))
        more = found.join(probe(chosen, i), "wid").join(postings, ["kid", "tv", "term"]).select("kid", "tv", "wid", F.array_distinct(grown).alias("spans")).where(F.size("spans") > 0)
        found = more.unionByName(found.join(short_of(chosen, i), "wid", "left_semi"))
    return found.select("kid", "tv", "wid")


def covered(hits: Column) -> Column:
    """How many places the (start, length) pairs of an ascending array cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, h: Column) -> Column:
        start, end = h["start"].cast("long"), (h["start"] + h["length"]).cast("long")
        return F.struct((acc["n"] + F.greatest(end - F.greatest(start, acc["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def search(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, depth: int = DEPTH, near: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The judged rows (kid, tv, doc_id, n_words, n_hit, wids), the items of the windows, and the proximity matches."""
    text = keyed_words(docs)
    wins, items = windows(benchmark, width)
    wins = written(wins, "windows")
    chosen = written(choose_terms(wins, term_counts(text), depth), "chosen")
    n_blocks = 1 + chosen.count() // BLOCK
    found, close = [], []
    for b in range(n_blocks):
        part = chosen.where(F.pmod(F.xxhash64("wid"), F.lit(n_blocks)) == b)
        postings = index(text, part)
        found.append(phrase_starts(postings, part, depth).join(F.broadcast(part.select("wid", "length")), "wid"))
        if near:
            close.append(near_windows(postings, part, depth))
    candidates = reduce(DataFrame.unionByName, found).select("kid", "tv", F.explode("starts").alias("start"), "length", "wid").groupBy("kid", "tv").agg(F.collect_list(F.struct("start", "length", "wid")).alias("candidates"))
    exact = F.filter(F.coalesce("candidates", F.array()), lambda c: window_id(F.slice("words", c["start"] + 1, c["length"])) == c["wid"])
    # texts travel, not their words
    whole = docs.select(*keys(), F.col("doc_id").cast("long").alias("doc_id"), "text").join(candidates, ["kid", "tv"], "left").withColumn("words", words(F.col("text")))
    judged = (whole.select("kid", "tv", "doc_id", F.size("words").cast("long").alias("n_words"), exact.alias("exact"))
              .select("kid", "tv", "doc_id", "n_words", covered(F.sort_array(F.transform("exact", lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"))))).alias("n_hit"),
                      F.array_distinct(F.transform("exact", lambda c: c["wid"])).alias("wids")))
    return written(judged, "judged"), items, reduce(DataFrame.unionByName, close).distinct() if near else None


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The documents without a hit; all columns stay."""
    hit = search(docs, benchmark, width, depth)[0].where("n_hit > 0").select("kid", "tv").distinct()
    return rows_keyed(docs).join(hit, ["kid", "tv"], "left_anti").select("row.*")


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, depth: int = DEPTH, near: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (ascending as strings), contaminated; one row for each row of docs.

    near adds n_near: how many windows have all their chosen terms close together there.
    """
    judged, items, close = search(docs, benchmark, width, depth, near)
    hit_items = judged.where("n_hit > 0").select("kid", "tv", F.explode("wids").alias("wid")).join(items, "wid").groupBy("kid", "tv").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = judged.join(hit_items, ["kid", "tv"], "left")
    if near:
        out = out.join(close.groupBy("kid", "tv").agg(F.count("*").alias("n_near")), ["kid", "tv"], "left").fillna(0, ["n_near"])
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated"), *(["n_near"] if near else []))
