"""Ranked search over an index of postings in blocks that carry the best score they can hold.

Active notices are numbered and put into blocks of BLOCK notices. A row of the postings is a term in a block: how many
notices hold it, its greatest frequency and the least size of those, and for each notice the frequency and the places.
Frequency and size bound the block's scores whatever the mean size of the corpus becomes, so a page of k reads the
places of blocks that can still reach the k-th score, and of phrases what their frequencies need.

Each batch of notices is a layer of its own. Notices that a later layer replaces or takes away are marked in the older
layers' blocks by the numbers that are gone, and the corpus sums follow; a query joins blocks, never keys.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.feed import Filters, active, bounded_limit, validate_search
from tidemark.operators.search import B, K1, MIN_IDF, phrases_of, tokenized
from tidemark.sources.shared import drop_folder, written

BLOCK = 256
#: Blocks that are scored first to get a bound for the others.
FIRST_BLOCKS = 16
#: Blocks whose words one task groups, so that it need not spill: some megabytes of text.
TASK_BLOCKS = 8
#: Bytes of a row group of the postings: what a query's terms don't touch isn't read.
ROW_GROUP = 4 << 20

_DOCS = "layer int, block long, docs array<struct<o:int,duid:string,category_id:string,posted_date:date,updated_date:date,size:int>>"
_POSTINGS = "layer int, term string, block long, n int, max_tf int, min_size int, entries array<struct<o:int,tf:int,size:int,at:array<struct<c:int,p:array<int>>>>>"
_KEYS = "layer int, duid string, block long, o int, size int"
_GONE = "upto int, layer int, block long, gone array<int>"
_SUMS = "upto int, n long, words long"


class BlockIndex:
    """The index in a folder. One writer at a time; a layer counts once its sums, the last thing of it, are written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/sums")
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.upto = self._table("sums", _SUMS).agg(F.max("upto")).first()[0] if files.exists(at) else None

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _layers(self, name: str, schema: str) -> DataFrame:
        return self._table(name, schema).where(F.col("layer") <= self.upto)

    def _write(self, df: DataFrame, name: str, part: str, number: int) -> None:
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.folder}/{name}/{part}={number}")

    # Writing

    def add(self, notices: DataFrame) -> None:
        """A batch of whole notices, one row a key: the active ones are indexed, what older layers have of these keys is gone."""
        layer = 0 if self.upto is None else self.upto + 1
        stage = f"{self.folder}/stage-{layer}"
        drop_folder(self.spark, stage)
        # Numbered once and written, so that all that is derived agrees on the numbers.
        number = F.monotonically_increasing_id()
        own = tokenized(notices).select("duid", "category_id", "posted_date", "updated_date", "_words", F.col("_size").cast("int").alias("size"), number.alias("_n"))
        own = written(own.withColumn("block", F.expr(f"_n div {BLOCK}")).withColumn("o", F.pmod("_n", F.lit(BLOCK)).cast("int")).drop("_n"), stage)
        docs = own.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("o", "duid", "category_id", "posted_date", "updated_date", "size"))).alias("docs"))
        self._write(docs, "docs", "layer", layer)
        self._write(own.select("duid", "block", "o", "size").repartitionByRange("duid").sortWithinPartitions("duid"), "keys", "layer", layer)
        added = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count_distinct("block").alias("blocks")).first()
        n, words = added["n"], added["words"]
        self._write(_posting_rows(own, max(1, added["blocks"] // TASK_BLOCKS)).repartitionByRange("term").sortWithinPartitions("term", "block"), "postings", "layer", layer)
        if self.upto is not None:
            hit = self._layers("keys", _KEYS).join(notices.select("duid").distinct(), "duid", "left_semi")
            before = self.gone()
            hit = hit.join(before, ["layer", "block"], "left").where(F.col("gone").isNull() | ~F.array_contains("gone", F.col("o"))).select("layer", "block", "o", "size")
            hit = written(hit, f"{self.folder}/hit-{layer}")
            both = before.unionByName(hit.groupBy("layer", "block").agg(F.collect_set("o").alias("gone")))
            self._write(both.groupBy("layer", "block").agg(F.flatten(F.collect_list("gone")).alias("gone")), "gone", "upto", layer)
            old, less = self.sums(), hit.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
            n, words = n + old["n"] - less["n"], words + old["words"] - less["words"]
            drop_folder(self.spark, f"{self.folder}/hit-{layer}")
        else:
            self._write(self.spark.createDataFrame([], "layer int, block long, gone array<int>"), "gone", "upto", layer)
        self._write(self.spark.createDataFrame([(n, words)], "n long, words long"), "sums", "upto", layer)
        drop_folder(self.spark, stage)
        self.upto = layer

    # Reading

    def sums(self):
        return self._table("sums", _SUMS).where(F.col("upto") == self.upto).first()

    def gone(self) -> DataFrame:
        """(layer, block, gone): the numbers of notices that later layers replaced or took away."""
        return self._table("gone", _GONE).where(F.col("upto") == self.upto).select("layer", "block", "gone")

    def postings(self, terms: list[str]) -> DataFrame:
        """Rows of these terms only: they are sorted by term, so files and row groups without them are skipped."""
        return self._layers("postings", _POSTINGS).where(F.col("term").isin(terms))

    def _blocks(self, terms: list[str], phrases: list[list[str]]) -> DataFrame:
        """(layer, block, tf0.., min_size): blocks in which all terms occur, with bounds. Reads no entries."""
        heads = self.postings(terms).select("layer", "block", "term", "n", "max_tf", "min_size")
        of = lambda t: F.max(F.when(F.col("term") == t, F.col("max_tf")))
        bounds = [F.least(*(of(t) for t in set(p))) if len(set(p)) > 1 else of(p[0]) for p in phrases]
        rows = heads.groupBy("layer", "block").agg(F.count(F.lit(1)).alias("k"), F.max("min_size").alias("min_size"), *(b.alias(f"tf{i}") for i, b in enumerate(bounds)))
        return rows.where(F.col("k") == len(terms)).drop("k")

    def _frequencies(self, blocks: DataFrame | None, terms: list[str], phrases: list[list[str]]) -> DataFrame:
        """(layer, block, o, _size, _tf) of notices that aren't gone and have all phrases; of these blocks, or of all.

        Places are read only where a phrase has several words.
        """
        rows = self.postings(terms)
        if blocks is not None:
            rows = rows.join(blocks.select("layer", "block"), ["layer", "block"], "left_semi")
        rows = rows.join(self.gone(), ["layer", "block"], "left")
        gone = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
        plain = all(len(p) == 1 for p in phrases)
        if not plain:
            rows = rows.repartition("layer", "block")  # All that follows groups inside blocks: places don't move one by one.
        entry = F.explode(F.filter("entries", lambda e: ~F.array_contains(gone, e["o"]))).alias("e")
        own = rows.select("layer", "block", "term", entry)
        if plain:
            found = own.groupBy("layer", "block", "e.o").agg(F.first("e.size").alias("_size"), *(F.sum(F.when(F.col("term") == p[0], F.col("e.tf")).otherwise(0)).cast("int").alias(f"f{i}") for i, p in enumerate(phrases)))
        else:
            flat = own.select("layer", "block", "term", F.col("e.o").alias("o"), F.col("e.size").alias("size"), F.explode("e.at").alias("a"))
            fields = flat.groupBy("layer", "block", "o", F.col("a.c").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("term", "a.p"))).alias("at"), F.first("size").alias("size"))
            none = F.expr("cast(array() as array<int>)")
            place = lambda t, k: F.transform(F.coalesce(F.try_element_at("at", F.lit(t)), none), lambda p: p - k)
            starts = [reduce(F.array_intersect, (place(t, k) for k, t in enumerate(p))) for p in phrases]
            found = fields.groupBy("layer", "block", "o").agg(F.first("size").alias("_size"), *(F.sum(F.size(s)).cast("int").alias(f"f{i}") for i, s in enumerate(starts)))
        names = [f"f{i}" for i in range(len(phrases))]
        return found.select("layer", "block", "o", "_size", F.array(*names).alias("_tf"))

    def matched(self, query: str) -> DataFrame:
        """(layer, block, o, _size, _tf, _df): notices that have all phrases; _df counts those that have each."""
        phrases = phrases_of(query)
        if not phrases:
            return self.spark.createDataFrame([], "layer int, block long, o int, _size int, _tf array<int>")
        found = self._frequencies(None, sorted({t for p in phrases for t in p}), phrases)
        return found.where(reduce(lambda a, b: a & b, (F.col("_tf")[i] > 0 for i in range(len(phrases)))))

    def _idf(self, found: DataFrame | None, phrases: list[list[str]], n: int) -> list[float]:
        """Weights of the phrases by the notices that have them: out of frequencies, or out of the blocks' counts for single words."""
        if found is not None:
            counts = list(found.agg(*(F.count_if(F.col("_tf")[i] > 0) for i in range(len(phrases)))).first())
        else:
            gone = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
            rows = self.postings([p[0] for p in phrases]).join(self.gone(), ["layer", "block"], "left")
            live = rows.groupBy("term").agg(F.sum(F.when(F.col("gone").isNull(), F.col("n")).otherwise(F.size(F.filter("entries", lambda e: ~F.array_contains(gone, e["o"]))))).alias("n"))
            of = {r["term"]: r["n"] for r in live.collect()}  # a number for each word of the query
            counts = [of.get(p[0], 0) for p in phrases]
        return [max(math.log((n - c + 0.5) / (c + 0.5)), 0) or MIN_IDF for c in counts]

    def _named(self, rows: DataFrame) -> DataFrame:
        """Rows with layer, block and o, and with what the index knows of the notice."""
        docs = self._layers("docs", _DOCS)
        blocks = rows.groupBy("layer", "block").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("layer", "block")])).alias("_rows"))
        both = docs.join(blocks, ["layer", "block"]).select("layer", "block", "docs", F.explode("_rows").alias("r"))
        doc = F.filter("docs", lambda d: d["o"] == F.col("r.o"))[0]
        return both.select("r.*", doc.alias("d")).select(*[c for c in rows.columns if c not in ("layer", "block")], "d.duid", "d.category_id", "d.posted_date", "d.updated_date")

    def top(self, query: str, filters: Filters = Filters(), limit: int = 10, offset: int = 0, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """(duid, score) of a page of the ranking: the lower the score, the better."""
        validate_search(query, limit, offset)
        phrases = phrases_of(query)
        if not phrases:
            return self.spark.createDataFrame([], "duid string, score double")
        terms = sorted({t for p in phrases for t in p})
        sums = self.sums()
        n, mean = sums["n"], (sums["words"] / sums["n"] if sums["n"] else 0.0) or 1.0
        k = offset + bounded_limit(limit)
        order = [F.col("score").asc(), F.col("updated_date").desc(), F.col("duid").desc()]

        def scored(found: DataFrame) -> DataFrame:
            hits = found.where(reduce(lambda a, b: a & b, (F.col("_tf")[i] > 0 for i in range(len(phrases)))))
            score = sum((_score(F.col("_tf")[i].cast("double"), F.col("_size"), idf[i], mean) for i in range(len(phrases))), F.lit(0.0))
            return filters.of(self._named(hits.select("layer", "block", "o", (-1.0 * score).alias("score")))).select("duid", "updated_date", "score").orderBy(*order).limit(k)

        if all(len(p) == 1 for p in phrases):
            idf = self._idf(None, phrases, n)
            bound = sum((_score(F.col(f"tf{i}").cast("double"), F.col("min_size"), idf[i], mean) for i in range(len(phrases))), F.lit(0.0))
            blocks = self._blocks(terms, phrases).select("layer", "block", bound.alias("bound"))
            best = blocks.orderBy(F.col("bound").desc(), "layer", "block").limit(first_blocks).select("layer", "block")
            floor = scored(self._frequencies(best, terms, phrases)).collect()  # k rows at most
            if len(floor) == k:
                # A little below the bound, as sums of the same terms may round differently.
                blocks = blocks.where(F.col("bound") >= -floor[-1]["score"] * (1 - 1e-12))
            rows = scored(self._frequencies(blocks, terms, phrases))
        else:
            # The weights of phrases need the frequencies in all blocks that have their words.
            found = self._frequencies(self._blocks(terms, phrases) if len(phrases) == 1 else None, terms, phrases)
            idf = self._idf(found, phrases, n)
            rows = scored(found)
        return rows.orderBy(*order).offset(offset).limit(bounded_limit(limit)).select("duid", "score")

    def hits(self, query: str) -> DataFrame:
        """(duid, _tf, ...) of all matches, with what the index knows of the notice."""
        return self._named(self.matched(query).select("layer", "block", "o", "_size", "_tf"))

    def count(self, query: str, filters: Filters = Filters()) -> DataFrame:
        """One row with n, the number of matches. Bounds on the updated date don't take part."""
        validate_search(query, 1, 0)
        own = Filters(filters.category_id, None, None, filters.posted_from, filters.posted_to)
        return own.of(self._named(self.matched(query))).agg(F.count(F.lit(1)).alias("n"))


def _score(tf: Column, size: Column, idf: float, mean: float) -> Column:
    return F.lit(idf) * (tf * (K1 + 1.0)) / (tf + K1 * (1 - B + B * size / F.lit(mean)))


def _posting_rows(own: DataFrame, tasks: int) -> DataFrame:
    """Rows (term, block, n, max_tf, min_size, entries) of numbered notices with _words.

    Only arrays of words move, once: a block's notices meet in one of the tasks, and all that is grouped is inside a block.
    """
    words = own.select("block", "o", "size", "_words").repartition(tasks, "block").select("block", "o", "size", F.posexplode("_words").alias("c", "words")).select("block", "o", "size", "c", F.posexplode("words").alias("p", "term"))
    fields = words.groupBy("block", "o", "term", "c").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("p")).alias("p"))
    notices = fields.groupBy("block", "term", "o").agg(F.sum(F.size("p")).cast("int").alias("tf"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("c", "p"))).alias("at"))
    rows = notices.groupBy("term", "block").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("size").alias("min_size"), F.sort_array(F.collect_list(F.struct("o", "tf", "size", "at"))).alias("entries"))
    return rows


def block_page(index: BlockIndex, notices: DataFrame, query: str, filters: Filters = Filters(), limit: int = 10, offset: int = 0) -> DataFrame:
    """The page's notices with score, in order. Whole notices are read for the page's keys only, at most MAX_LIMIT."""
    top = index.top(query, filters, limit, offset).collect()
    if not top:
        return notices.withColumn("score", F.lit(0.0)).limit(0)
    places = notices.sparkSession.createDataFrame([(r["duid"], r["score"], k) for k, r in enumerate(top)], "duid string, score double, _place int")
    rows = active(notices).where(F.col("duid").isin([r["duid"] for r in top])).join(F.broadcast(places), "duid")
    return rows.orderBy("_place").select(*notices.columns, "score")
