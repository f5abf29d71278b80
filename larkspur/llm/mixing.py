"""Mixing sources to target weights. DataFrame expressions only.

A source's documents are laid end to end in streams and cut into blocks of a fixed number of words. Slots of the mix are
dealt to output shards at random, so a shard's source counts are a multinomial draw; the draw is conditioned on each
source's slots in the whole mix, which are its target over its words a block, because free draws would miss a small
source's target by one over the root of its slots (7 % at 200). A source's q-th slot takes the block to which the
source's pseudorandom permutation of round q // blocks maps q % blocks, so every block is used once before any is used
again, and slots meet blocks in a join by index.

Permutations are swap-or-not networks keyed by hashes: bijections of any size, with no state, so a lost task and a rerun
give the same mix. Streams, slots and blocks are dealt by (source, number), so a source with a third of all rows is
spread; rows alike in source, id and text are counted first and laid out as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.ordered import running_totals
from larkspur.llm.common import materialize, same_row, small
from larkspur.llm.ranks import positions, same_keys

#: Weights of the sources in order, repeating, and how often a source may be repeated.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words of a block at most; a source's target holds PARTS blocks at least, if its blocks have more than one word.
BLOCK, PARTS = 256, 256
#: Slots of an output shard; documents of a stream on average; blocks that are joined as one row.
SHARD, STREAM, GROUP = 1024, 4096, 256
#: Copies of a row and slots of a source that one row is exploded to.
SPREAD = 8192
ROUNDS = 40


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *seed: Column, rounds: int = ROUNDS) -> Column:
    """The place of x in a pseudorandom permutation of 0 to n - 1 that the seed names: in each round x and its mirror
    image around a keyed point change places, or not, by a keyed bit of the larger of the two."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("point"), r, *seed), n) - at, n)
        swap = F.xxhash64(F.lit("swap"), r, F.greatest(at, other), *seed).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, sid, weight, size, target) of sizes (source, size), one row a source: all words are shared by weight,
    and what exceeds `repeats` times a source's size goes to the others by weight until none exceeds it.

    sid numbers the sources by code point, null last; weights repeat in that order. Sums are whole numbers, so the
    targets don't depend on the order of rows. The driver holds three numbers; a round is an aggregate over sources.
    """
    ranked = positions(sizes, [], [F.col("source").asc_nulls_last()], "sources").drop("n").withColumnRenamed("pos", "sid")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights)).cast("int")).cast("long")
    ranked = materialize(ranked.withColumn("weight", weight), "weights")
    total, free = ranked.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    most, held, whole = F.col("size") * repeats, 0, F.lit(False)
    while free:
        # A source is held at its most if its share of the rest reaches it.
        big = lambda c: c.cast("decimal(38,0)")
        whole = big(most) * F.lit(free).cast("decimal(15,0)") <= F.lit(total - held).cast("decimal(19,0)") * big(F.col("weight")).cast("decimal(10,0)")
        now, rest = ranked.agg(F.coalesce(F.sum(F.when(whole, most)), F.lit(0)), F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0))).first()
        if (now, rest) == (held, free):
            break
        held, free = now, rest
    share = F.col("weight") * F.lit((total - held) / free if free else 0.0)
    return ranked.select("source", "sid", "weight", "size", F.when(whole, most.cast("double")).otherwise(share).alias("target"))


class Mix:
    """What a mix is made of, as written tables: `sources`, `rows` (each distinct row's place) and `slots`."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, shard: int = SHARD, block: int = BLOCK):
        text = F.col(text_col).cast("string")
        keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), words(text).alias("size"))
        keyed = materialize(keyed.groupBy("source", "doc_id", "text_key", "size").agg(F.count("*").alias("copies")), "sizes")
        totals = keyed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows"))
        named = targets(materialize(totals, "totals").select("source", "size"))
        length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / PARTS))).cast("long")
        named = named.withColumn("length", length)
        totals = totals.select("source", F.ceil(F.col("rows") / STREAM).cast("long").alias("streams"))
        named = materialize(named.join(totals, named["source"].eqNullSafe(totals["source"])).drop(totals["source"]), "targets")
        self.rows = self._laid(keyed, named)
        blocks = self.rows.groupBy("sid").agg(F.max("blocks").alias("blocks"))
        self.sources = self._counted(named, blocks)
        self.many = self.rows.where(F.col("copies") > SPREAD).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        self.seed, self.shard = F.lit(seed), shard

    @staticmethod
    def _laid(keyed: DataFrame, named: DataFrame) -> DataFrame:
        """Rows with their stream's first block (`base`), their first word in the stream (`start`), and the source's blocks."""
        few = small(named.select("source", "sid", "length", "streams"))
        met = keyed.join(few, keyed["source"].eqNullSafe(few["source"])).drop(few["source"])
        met = met.withColumn("stream", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("streams")))
        inside = Window.partitionBy("sid", "stream").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
        met = materialize(met.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))), "streams")
        # A row a stream, some thousandth of the documents.
        ends = met.groupBy("sid", "stream").agg(F.ceil(F.max(F.col("start") + F.col("size") * F.col("copies")) / F.first("length")).cast("long").alias("n"))
        own = Window.partitionBy("sid")
        ends = ends.withColumns({"base": F.coalesce(F.sum("n").over(own.orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "blocks": F.sum("n").over(own)})
        return materialize(met.join(small(materialize(ends.drop("n"), "bases")), ["sid", "stream"]).drop("stream", "streams"), "laid")

    @staticmethod
    def _counted(named: DataFrame, blocks: DataFrame) -> DataFrame:
        """Sources with their blocks, their slots and the slots of the sources before."""
        found = named.join(blocks, "sid")
        fair = F.round(F.col("target") * F.col("blocks") / F.col("size")).cast("long")
        found = found.withColumn("slots", F.when(F.col("size") > 0, F.least(fair, REPEATS * F.col("blocks"))).otherwise(F.lit(0)).cast("long"))
        return materialize(running_totals(materialize(found, "found"), "sid", ["slots"]).withColumn("first", F.col("run_slots") - F.col("slots")).drop("run_slots", "streams"), "sources")

    def slots(self) -> DataFrame:
        """(shard, slot, sid, block) of the whole mix: what each slot of each shard takes."""
        total = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
        n = F.lit(total).cast("long")
        parts = self.sources.where("slots > 0").select("sid", "blocks", "slots", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SPREAD))).alias("part"))
        start = F.col("part") * SPREAD
        q = F.explode(F.sequence(start, F.least(start + SPREAD, F.col("slots")) - 1)).alias("q")
        # By number: what is dealt here is few rows, each of which becomes many.
        every = parts.repartition(total // (4 * SPREAD) + 1, "sid", "part").select("sid", "blocks", "first", q)
        place = permuted(F.col("first") + F.col("q"), n, self.seed)
        block = permuted(F.col("q") % F.col("blocks"), F.col("blocks"), self.seed, F.col("sid"), F.floor(F.col("q") / F.col("blocks")))
        return every.select(place.alias("place"), "sid", block.alias("block")).select(F.floor(F.col("place") / self.shard).alias("shard"), (F.col("place") % self.shard).alias("slot"), "sid", "block")

    def counts(self) -> DataFrame:
        """(shard, source, slots): the source counts drawn for each output shard."""
        drawn = self.slots().groupBy("shard", "sid").agg(F.count("*").alias("slots"))
        return drawn.join(small(self.sources.select("sid", "source")), "sid").select("shard", "source", "slots")

    def _copies(self) -> DataFrame:
        """Each row of the input, copies numbered and one after the other; a row of many copies is spread first."""
        many = self.rows.where(F.col("copies") > SPREAD)
        last = F.floor((F.col("copies") - 1) / SPREAD)
        spread = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
        spread = spread.repartition(self.many // (4 * SPREAD) + 1, "sid", "doc_id", "text_key", "part")
        every = self.rows.where(F.col("copies") <= SPREAD).withColumn("part", F.lit(0).cast("long")).unionByName(spread)
        start = F.col("part") * SPREAD
        every = every.withColumn("copy", F.explode(F.sequence(start, F.least(start + SPREAD, F.col("copies")) - 1)))
        return every.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("part", "copies")

    def _touched(self, per: int) -> DataFrame:
        """Copies that have words, once for each group of `per` blocks that they touch; `word` is their first word's
        number if the source's blocks were all whole."""
        every = self._copies().where("size > 0").withColumn("word", F.col("base") * F.col("length") + F.col("start"))
        first, last = F.floor(F.col("word") / F.col("length") / per), F.floor((F.col("word") + F.col("size") - 1) / F.col("length") / per)
        return every.withColumn("group", F.explode(F.sequence(first, last)))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), a row for each row of the input."""
        used = self.slots().groupBy("sid", F.floor(F.col("block") / GROUP).alias("group")).agg(F.collect_list("block").alias("used"))
        met = self._touched(GROUP).select("sid", "doc_id", "text_key", "copy", "size", "length", "word", "group").join(used, ["sid", "group"], "left")
        # Of each use of a block of this group, the words that are the document's.
        begin = lambda b: F.greatest(F.col("word"), b * F.col("length"))
        end = lambda b: F.least(F.col("word") + F.col("size"), (b + 1) * F.col("length"))
        mine = F.aggregate(F.coalesce("used", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda acc, b: acc + F.greatest(end(b) - begin(b), F.lit(0).cast("long")))
        sums = met.select("sid", "doc_id", "text_key", "copy", "size", mine.alias("taken")).groupBy("sid", "doc_id", "text_key", "copy", "size").agg(F.sum("taken").alias("taken"))
        empty = self._copies().where("size = 0").select("sid", "doc_id", "text_key", "copy", "size", F.lit(0).cast("long").alias("taken"))
        few = small(self.sources.select("sid", F.col("size").alias("source_size"), "target"))
        return sums.unionByName(empty).join(few, "sid").select("doc_id", "size", "source_size", "target", "taken")

    def mixed(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
        """(shard, slot, source, block, text): the mix itself, each block's words joined by spaces. docs are those that
        the mix was made of."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_key"), text.alias("text")).dropDuplicates(["source", "doc_id", "text_key"])
        few = small(self.sources.select("sid", "source"))
        texts = texts.join(few, texts["source"].eqNullSafe(few["source"])).select("sid", "doc_id", "text_key", F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)).alias("words"))
        places = self._touched(1)
        met = places.join(texts, same_row(places, texts) & (places["sid"] == texts["sid"])).select(places["sid"], "word", "length", "size", "group", "words", "copy")
        begin = F.greatest(F.col("word"), F.col("group") * F.col("length"))
        end = F.least(F.col("word") + F.col("size"), (F.col("group") + 1) * F.col("length"))
        piece = F.array_join(F.slice("words", (begin - F.col("word") + 1).cast("int"), (end - begin).cast("int")), " ")
        blocks = met.groupBy("sid", F.col("group").alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(begin.alias("at"), piece.alias("piece")))), lambda x: x["piece"]), " ").alias("text"))
        return self.slots().join(blocks, ["sid", "block"]).join(few, "sid").select("shard", "slot", "source", "block", "text")


def mix_shares(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs: its words, its source's, the source's target and
    how many of the row's words the mix takes, repeats counted.

    A null text has no words and nothing is taken of it; null sources are a source of their own, the last. Repeated rows
    are rows of their own. A source's target can't be met closer than about a block, a 256th of it at most. Sources
    without words have the target 0. No rows give no rows. Other columns of docs may have any name.
    """
    return Mix(docs, **options).taken()
