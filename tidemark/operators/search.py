"""Ranked full-text search as Column expressions: tokens, phrases, BM25.

Every chunk of a query between blanks is a phrase; all phrases must occur, each within one column. Operators of
query languages have no meaning, they are separators like other punctuation.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.errors import StorageUnavailableError
from tidemark.operators.feed import Filters, active, active_count, bounded_limit, unranked_page, validate_search

COLUMNS = ("title", "category_name", "department", "body")
# Constants of BM25 and the least weight of a phrase.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6


@cache
def _folding() -> tuple[str, str]:
    """Latin letters with one mark, and the letters without it."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code).lower())
        if len(parts) >= 2 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]) and chr(code).lower() == chr(code):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def tokens(text: Column) -> Column:
    """Array of lower-cased runs of letters and digits, diacritics taken off."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Mn}", ""))
    return F.regexp_extract_all(F.translate(bare, *_folding()), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    size = len(phrase)
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    whole = F.array(*[F.lit(p) for p in phrase])
    return F.size(F.filter(starts, lambda i: F.slice(words, i, size) == whole))


def phrases_of(query: str) -> list[list[str]]:
    """The query's chunks as token lists, made like the tokens of texts; chunks without a token are left out."""
    if "\x00" in query:
        raise StorageUnavailableError("search")
    source, target = _folding()
    table = str.maketrans(source, target)
    found = []
    for chunk in query.split():
        bare = "".join(c for c in chunk if unicodedata.category(c) != "Mn").lower().translate(table)
        words, word = [], ""
        for c in bare + " ":
            if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
                word += c
            elif word:
                words.append(word)
                word = ""
        if words:
            found.append(words)
    return found


def search_index(notices: DataFrame) -> DataFrame:
    """The searchable projection: active notices only, a body that isn't kept counts as empty."""
    return active(notices).select("duid", "title", "category_name", "department", F.coalesce("body", F.lit("")).alias("body"))


def tokenized(notices: DataFrame) -> DataFrame:
    """Active notices with _words (an array of tokens for each column) and _size (tokens in all)."""
    own = active(notices).withColumn("_words", F.array(*[tokens(F.col(c)) for c in COLUMNS]))
    return own.withColumn("_size", F.aggregate("_words", F.lit(0), lambda n, w: n + F.size(w)))


def _frequency(phrase: list[str]) -> Column:
    return F.aggregate("_words", F.lit(0), lambda n, w: n + phrase_count(w, phrase))


def matched(notices: DataFrame, query: str) -> DataFrame:
    """Active notices in which all phrases occur, with _tf (an array by phrase). None if the query has no token."""
    phrases = phrases_of(query)
    own = tokenized(notices)
    if not phrases:
        return own.withColumn("_tf", F.expr("cast(array() as array<int>)")).where(F.lit(False))
    own = own.withColumn("_tf", F.array(*[_frequency(p) for p in phrases]))
    return own.where(reduce(lambda a, b: a & b, (F.col("_tf")[i] > 0 for i in range(len(phrases)))))


def ranked(notices: DataFrame, query: str) -> DataFrame:
    """Matches with score: the lower, the better. Counts of the corpus are over all active notices, whatever filters follow.

    One pass gives the corpus counts (a few numbers), the next one scores.
    """
    phrases = phrases_of(query)
    if not phrases:
        return matched(notices, query).withColumn("score", F.lit(0.0))
    counts = tokenized(notices).agg(F.count(F.lit(1)).alias("n"), F.avg("_size").alias("mean"), *[F.count_if(_frequency(p) > 0).alias(f"df{i}") for i, p in enumerate(phrases)]).first()
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df = counts[f"df{i}"]
        idf = math.log((counts["n"] - df + 0.5) / (df + 0.5)) if counts["n"] else 0.0
        idf = idf if idf > 0 else MIN_IDF
        tf = F.col("_tf")[i].cast("double")
        score = score + F.lit(idf) * (tf * (K1 + 1.0)) / (tf + K1 * (1 - B + B * F.col("_size") / F.lit(counts["mean"] or 1.0)))
    return matched(notices, query).withColumn("score", -1.0 * score)


def search_page(notices: DataFrame, query: str = "", filters: Filters = Filters(), limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of the ranking, or of the unranked order for a blank query; with the columns of notices."""
    validate_search(query, limit, offset)
    if not query.strip():
        return unranked_page(notices, filters, limit, offset)
    found = filters.of(ranked(notices, query)).orderBy(F.col("score").asc(), F.col("updated_date").desc(), F.col("duid").desc())
    return found.offset(offset).limit(bounded_limit(limit)).select(*notices.columns, "score")


def search_count(notices: DataFrame, query: str = "", filters: Filters = Filters()) -> DataFrame:
    """One row with n, the number of matches. Bounds on the updated date don't take part, as in the page's total."""
    validate_search(query, 1, 0)
    own = Filters(filters.category_id, None, None, filters.posted_from, filters.posted_to)
    if not query.strip():
        return active_count(notices, own)
    return own.of(matched(notices, query)).agg(F.count(F.lit(1)).alias("n"))


def postings(notices: DataFrame) -> DataFrame:
    """(term, duid, column, positions): an inverted index for corpora whose token arrays are too large to scan for each query."""
    words = F.posexplode(F.array(*[tokens(F.col(c)) for c in COLUMNS])).alias("c", "words")
    own = active(notices).select("duid", words)
    flat = own.select("duid", F.col("c").alias("column"), F.posexplode("words").alias("position", "term"))
    return flat.groupBy("term", "duid", "column").agg(F.sort_array(F.collect_list("position")).alias("positions"))


# A kept index: a query reads the postings of its terms only, and nothing is tokenized again.


@dataclass(frozen=True)
class SearchIndex:
    """Postings that may hold old versions of a notice, the current notices with their _version, and sums over the active ones."""

    postings: Callable[[list[str]], DataFrame]  # of these terms: term, duid, _version, column, positions, size
    notices: DataFrame
    n: int
    words: int


def index_rows(notices: DataFrame) -> DataFrame:
    """(term, duid, _version, column, positions, size) of active notices with a _version: what a store keeps of them.

    size is the number of tokens of the notice. A notice's tokens meet in one task, as its text does; a term's postings
    are spread over its notices.
    """
    own = tokenized(notices).select("duid", "_version", F.col("_size").alias("size"), F.posexplode("_words").alias("column", "words"))
    flat = own.select("duid", "_version", "column", "size", F.posexplode("words").alias("position", "term"))
    return flat.groupBy("duid", "_version", "column", "term").agg(F.sort_array(F.collect_list("position")).alias("positions"), F.first("size").alias("size"))


def index_sums(notices: DataFrame) -> DataFrame:
    """One row: rows, of which n are active notices, and the words (tokens) of those."""
    size = F.when(F.col("tombstone_at").isNull(), reduce(lambda a, b: a + b, (F.size(tokens(F.col(c))) for c in COLUMNS)))
    return notices.select(size.alias("size")).agg(F.count(F.lit(1)).alias("rows"), F.count("size").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("words"))


def _less(positions: Column, k: int) -> Column:
    return F.transform(positions, lambda p: p - k) if k else positions


def indexed_frequencies(index: SearchIndex, phrases: list[list[str]]) -> DataFrame:
    """(duid, _size, _tf) of the active notices that have a term of the phrases. A phrase begins where all its terms do, each less its place."""
    terms = sorted({t for p in phrases for t in p})
    live = active(index.notices).select("duid", "_version")
    own = index.postings(terms).join(live, ["duid", "_version"], "left_semi")
    fields = own.groupBy("duid", "column").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("size").alias("size"))
    none = F.expr("cast(array() as array<int>)")
    starts = [reduce(F.array_intersect, (_less(F.coalesce(F.try_element_at("at", F.lit(t)), none), k) for k, t in enumerate(p))) for p in phrases]
    return fields.groupBy("duid").agg(F.first("size").alias("_size"), F.array(*[F.sum(F.size(s)).cast("int") for s in starts]).alias("_tf"))


def indexed_scores(index: SearchIndex, query: str) -> DataFrame | None:
    """(duid, score) of all matches, as ranked() gives them; None if the query has no token."""
    phrases = phrases_of(query)
    if not phrases:
        return None
    found = indexed_frequencies(index, phrases)
    documents = found.agg(F.array(*[F.count_if(F.col("_tf")[i] > 0) for i in range(len(phrases))]).alias("df")).scalar()
    mean = (index.words / index.n if index.n else 0.0) or 1.0
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.lit(float(index.n)) - documents[i] + 0.5) / (documents[i] + 0.5))
        tf = F.col("_tf")[i].cast("double")
        score = score + F.when(idf > 0, idf).otherwise(MIN_IDF) * (tf * (K1 + 1.0)) / (tf + K1 * (1 - B + B * F.col("_size") / F.lit(mean)))
    return found.where(reduce(lambda a, b: a & b, (F.col("_tf")[i] > 0 for i in range(len(phrases))))).select("duid", (-1.0 * score).alias("score"))


def indexed_page(index: SearchIndex, query: str = "", filters: Filters = Filters(), limit: int = 10, offset: int = 0) -> DataFrame:
    """search_page by the index. Whole notices are read for the page's keys only, which are at most MAX_LIMIT."""
    validate_search(query, limit, offset)
    notices = index.notices.drop("_version")
    if not query.strip():
        return unranked_page(notices, filters, limit, offset)
    scored = indexed_scores(index, query)
    if scored is None:
        return notices.withColumn("score", F.lit(0.0)).limit(0)
    slim = notices.select("duid", "category_id", "posted_date", "updated_date")
    order = [F.col("score").asc(), F.col("updated_date").desc(), F.col("duid").desc()]
    top = filters.of(scored.join(slim, "duid")).orderBy(*order).offset(offset).limit(bounded_limit(limit)).select("duid", "score").collect()
    keys = [r["duid"] for r in top]
    places = F.create_map(*[F.lit(x) for k, r in enumerate(top) for x in (r["duid"], k)]) if top else None
    rows = notices.where(F.col("duid").isin(keys)) if top else notices.limit(0)
    scores = F.array(*[F.lit(r["score"]) for r in top]) if top else F.array(F.lit(0.0))
    place = places[F.col("duid")] if top else F.lit(0)
    return rows.withColumn("_place", place).orderBy("_place").select(*notices.columns, scores[F.col("_place")].alias("score"))


def indexed_count(index: SearchIndex, query: str = "", filters: Filters = Filters()) -> DataFrame:
    """search_count by the index."""
    validate_search(query, 1, 0)
    notices, own = index.notices.drop("_version"), Filters(filters.category_id, None, None, filters.posted_from, filters.posted_to)
    scored = indexed_scores(index, query) if query.strip() else None
    if not query.strip():
        return active_count(notices, own)
    if scored is None:
        return notices.limit(0).agg(F.count(F.lit(1)).alias("n"))
    return own.of(scored.join(notices.select("duid", "category_id", "posted_date"), "duid")).agg(F.count(F.lit(1)).alias("n"))
