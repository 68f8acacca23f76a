"""Clustering of one collection by a judge, in rounds of joins.

The pool is a stored BM25 index of all items' texts, whose terms carry the block, so items of different blocks never
meet. It gives each item its nearest others once; what a judge says of two texts is a column. Equal texts are one
item, told by their normalised form; their copies follow it.

Items are decided in rounds. In each, an open item looks at the clusters of its decided neighbours, at most
``shown_limit`` of them by their nearest member, and the judge compares it with some members of each. It joins the
cluster it is most like, if its least like member there agrees. One that fits nowhere starts a cluster once no open
neighbour that isn't surely different comes before it; the order is that of hashed ids, so of many like items some are first
everywhere and few rounds are needed, however the input is sorted. One that is unsure stays open.

Refinement tries open items again, merges pairs of clusters that are each other's best partner, and moves members that
another cluster fits better, all from the state as it was before. Blocks end by themselves: when a state comes back, or
the iterations run out. Each round is one plan over all blocks and is written before the next one, so a run goes on
from the last written round where an executor is lost. Nothing of a cluster but a few members is gathered in one row.
Tables that grow with the items meet by shuffles alone: a round has many joins, and none sends a table by the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import text as tx
from .cluster import mint_id
from .index import TextIndex, identity_of

#: Blocks up to which a list of them is broadcast, so that a block of very many items stays dealt; more are no large blocks, mostly.
BLOCKS = 20_000
#: Outcomes of an item.
SEED, ASSIGNED, DEFERRED, FAILED = "seed", "assigned", "deferred", "failed"
ACCEPTED, OPEN = (SEED, ASSIGNED), (DEFERRED, FAILED)
STATE = ("block", "id", "priority", "outcome", "cluster", "reason", "proposal", "sure", "since")


@dataclass(frozen=True)
class Settings:
    """How much is searched and shown, and what each verdict must reach. Fixed values of the defaults."""

    retrieve_limit: int = 20
    shown_limit: int = 8
    member_evidence: int = 5
    evidence_chars: int = 200
    assign_accept_at: float = 0.7
    assign_review_floor: float = 0.5
    novelty_accept_at: float = 0.7
    merge_accept_at: float = 0.8
    merge_review_floor: float = 0.6
    comparative_accept_at: float = 0.8
    max_refine_iterations: int = 2
    consolidate: bool = True
    reassign: bool = True
    order: str = "label"

    def __post_init__(self) -> None:
        if min(self.retrieve_limit, self.shown_limit, self.member_evidence) < 1:
            raise ValueError("limits must be 1 at least")
        if self.assign_review_floor > self.assign_accept_at or self.merge_review_floor > self.merge_accept_at:
            raise ValueError("a review floor must not exceed its accept level")


@dataclass(frozen=True)
class Judge:
    """``alike``: how alike two texts are, 0 to 1, as a column of both; null where there is no answer.

    From ``same_at`` on they are the same, surer the farther from it; another cluster must fit better by ``gain``.
    """

    alike: Callable[[Column, Column], Column]
    same_at: float = 0.6
    margin: float = 0.2
    gain: float = 0.1

    def sure(self, score: Column) -> Column:
        return F.round(0.5 + 0.5 * F.least(F.lit(1.0), F.abs(score - self.same_at) / self.margin), 3)


def lexical_judge(same_at: float = 0.6, margin: float = 0.2, gain: float = 0.1) -> Judge:
    """Goes by the Jaccard overlap of words."""
    words = lambda c: F.array_distinct(F.filter(F.split(tx.match_key(c), " "), lambda x: x != ""))
    return Judge(lambda a, b: tx.jaccard(words(a), words(b)), same_at, margin, gain)


class Run:
    """The tables of one run: items, their texts as shown, their neighbours, and the states."""

    def __init__(self, items: DataFrame, judge: Judge, settings: Settings, name: str) -> None:
        self.work, self.judge, self.settings, self.name = store.Work(items.sparkSession, "engine"), judge, settings, name
        self.number = 0
        self.items = self.work.save(placed(items), "items")
        repeated = self.items.groupBy("id").count().where("count > 1").limit(3).collect()
        if repeated:
            raise ValueError(f"repeated ids: {[r.id for r in repeated]}")
        one = F.min(F.struct("priority", "id"))
        heads = self.items.groupBy("block", "form").agg(one.alias("head")).select("block", "form", F.col("head.id").alias("head"))
        self.copies = self.work.save(self.items.join(store.dealt(heads), ["block", "form"]).select("block", "id", "head"), "copies")
        self.lines = self.work.save(self.items.join(store.dealt(self.copies.where("id = head").select("id")), "id", "left_semi").select("block", "id", "priority", clipped(F.col("label"), settings.evidence_chars).alias("line")), "lines")
        self.pairs = self.work.save(self.neighbours(), "pairs")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        return self.work.save(df, f"{name}{self.number}")

    def neighbours(self) -> DataFrame:
        """``id``, ``other``, ``rank``, ``score`` of the nearest texts of each, in both directions."""
        mark = F.lower(F.hex(F.xxhash64("block")))
        text = F.array_join(F.transform(tx.tokens(F.col("line")), lambda t: F.concat(mark, F.lit("_"), t)), " ")
        tagged = self.lines.select("id", text.alias("text"))
        index = TextIndex.build(tagged, f"{self.work.root}/pool", identity_of(pool=self.name))
        near = index.search(tagged.withColumnRenamed("id", "query_id"), self.settings.retrieve_limit + 1).where("query_id <> id").select(F.col("query_id").alias("id"), F.col("id").alias("other"), "rank")
        both = near.unionByName(near.select(F.col("other").alias("id"), F.col("id").alias("other"), "rank")).groupBy("id", "other").agg(F.min("rank").alias("rank"))
        own, theirs = self.lines.select("id", "priority", F.col("line").alias("a")), self.lines.select(F.col("id").alias("other"), F.col("priority").alias("before"), F.col("line").alias("b"))
        judged = both.join(store.dealt(own), "id").join(store.dealt(theirs), "other")
        return judged.select("id", "other", "rank", self.judge.alike(F.col("a"), F.col("b")).alias("score"), (F.col("before") < F.col("priority")).alias("earlier"))

    def unsettled(self) -> Column:
        """Whether two texts are not surely different: the later one waits for the earlier."""
        score = F.col("score")
        return F.coalesce((score >= self.judge.same_at) | (self.judge.sure(score) < self.settings.novelty_accept_at), F.lit(True))

    def evidence(self, state: DataFrame) -> DataFrame:
        """``cluster``, ``member``, ``b`` (its text) of the first members of each cluster."""
        order = Window.partitionBy("cluster").orderBy("since", "priority", "id")
        first = state.where(F.col("outcome").isin(*ACCEPTED)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.settings.member_evidence)
        return first.select("cluster", F.col("id").alias("member")).join(store.dealt(self.lines.select(F.col("id").alias("member"), F.col("line").alias("b"))), "member")

    def shown(self, asking: DataFrame, state: DataFrame) -> DataFrame:
        """``id``, ``cluster``, ``rank``: the clusters of an item's accepted neighbours, the nearest first."""
        held = state.where(F.col("outcome").isin(*ACCEPTED)).select(F.col("id").alias("other"), "cluster")
        near = self.pairs.join(store.dealt(asking.select("id")), "id", "left_semi").join(store.dealt(held), "other").groupBy("id", "cluster").agg(F.min("rank").alias("rank"))
        return near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("rank", "cluster"))).where(F.col("n") <= self.settings.shown_limit).drop("n")

    def compared(self, shown: DataFrame, evidence: DataFrame) -> DataFrame:
        """``shown`` with ``mean`` and ``least`` of what the judge says of the item and the cluster's other members, the ``share`` that agrees, and ``unclear``."""
        rows = shown.join(store.dealt(evidence), "cluster").where("member <> id").join(store.dealt(self.lines.select("id", F.col("line").alias("a"))), "id")
        said = rows.select(*shown.columns, self.judge.alike(F.col("a"), F.col("b")).alias("score"))
        return said.groupBy(*shown.columns).agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.count_if(F.col("score").isNull()).alias("unclear"), F.avg((F.col("score") >= self.judge.same_at).cast("double")).alias("share"))

    def verdicts(self, asking: DataFrame, state: DataFrame) -> DataFrame:
        """``id``, ``to_outcome``, ``to_cluster``, ``to_reason``, ``to_proposal``, ``to_sure`` of each asking item; a new cluster has no name yet."""
        s, judge = self.settings, self.judge
        found = self.compared(self.shown(asking, state), self.evidence(state))
        best = found.groupBy("id").agg(F.max(F.struct("mean", (-F.col("rank")).alias("near"), "cluster", "least")).alias("best"), F.sum("unclear").alias("unclear"))
        rows = asking.select("id").join(store.dealt(best), "id", "left")
        mean, least = F.coalesce("best.mean", F.lit(0.0)), F.col("best.least")
        fits, agrees = mean >= judge.same_at, least >= judge.same_at
        outcome = (
            F.when(F.col("unclear") > 0, FAILED).when(fits & agrees & (judge.sure(least) >= s.assign_accept_at), ASSIGNED).when(fits, DEFERRED)
            .when(judge.sure(mean) >= s.novelty_accept_at, SEED).otherwise(DEFERRED)
        )
        rows = rows.withColumn("to_outcome", outcome)
        reason = (
            F.when(F.col("to_outcome") == FAILED, "invalid_output").when(F.col("to_outcome") == ASSIGNED, "verified").when(F.col("to_outcome") == SEED, "minted:neighbours_exhausted")
            .when(~fits, "novelty_below_threshold").when(~agrees, "verifier_rejected").when(judge.sure(least) >= s.assign_review_floor, "below_accept_threshold").otherwise("below_review_floor")
        )
        return rows.select("id", "to_outcome", F.when(F.col("to_outcome") == ASSIGNED, F.col("best.cluster")).alias("to_cluster"), reason.alias("to_reason"), F.when(F.col("to_outcome") == DEFERRED, F.col("best.cluster")).alias("to_proposal"), F.when(fits, judge.sure(least)).otherwise(judge.sure(mean)).alias("to_sure"))

    def taken(self, state: DataFrame, verdicts: DataFrame, since: int) -> DataFrame:
        """The state with these verdicts; new clusters are named by their seed."""
        both = state.join(store.dealt(verdicts), "id", "left")
        new = F.col("to_outcome").isNotNull()
        cluster = F.when(F.col("to_outcome") == SEED, mint_id(self.name, F.concat_ws("#", "id", F.lit(str(since))))).otherwise(F.col("to_cluster"))
        pick = lambda name, value: F.when(new, value).otherwise(F.col(name)).alias(name)
        return both.select("block", "id", "priority", pick("outcome", F.col("to_outcome")), pick("cluster", cluster), pick("reason", F.col("to_reason")), pick("proposal", F.col("to_proposal")), pick("sure", F.col("to_sure")), pick("since", F.lit(since)))

    def stream(self) -> DataFrame:
        """The state when every item is decided once."""
        kinds = {"outcome": "string", "cluster": "string", "reason": "string", "proposal": "string", "sure": "double", "since": "int"}
        state, turn = self.save(self.lines.select("block", "id", "priority", *(F.lit(None).cast(k).alias(n) for n, k in kinds.items())), "state"), 0
        while True:
            asking = state.where("outcome is null").select("id")
            waits = self.pairs.where(self.unsettled() & F.col("earlier")).join(store.dealt(asking), "id", "left_semi").join(store.dealt(asking.select(F.col("id").alias("other"))), "other", "left_semi")
            said = self.verdicts(asking, state).join(store.dealt(waits.select("id").distinct().withColumn("waits", F.lit(True))), "id", "left")
            # While one before it is open, an item takes no decision but to join or fail.
            said = said.where(F.col("waits").isNull() | F.col("to_outcome").isin(ASSIGNED, FAILED)).drop("waits")
            state, turn = self.save(self.taken(state, said, turn), "state"), turn + 1
            if state.where("outcome is null").isEmpty():
                return state

    def retried(self, state: DataFrame, going: DataFrame, since: int, outcomes: tuple[str, ...] = OPEN) -> DataFrame:
        """Open items again; of those that would start a cluster the first of each neighbourhood does."""
        asking = state.where(F.col("outcome").isin(*outcomes)).join(going, "block", "left_semi").select("id")
        said = self.save(self.verdicts(asking, state), "retry")
        seeds = said.where(F.col("to_outcome") == SEED).select("id")
        waits = self.pairs.where(self.unsettled() & F.col("earlier")).join(store.dealt(seeds), "id", "left_semi").join(store.dealt(seeds.select(F.col("id").alias("other"))), "other", "left_semi").select("id").distinct()
        return self.save(self.taken(state, said.join(store.dealt(waits), "id", "left_anti"), since), "state")

    def merged(self, state: DataFrame, going: DataFrame, iteration: int) -> tuple[DataFrame, DataFrame]:
        """The state after merges, and the merges: pairs of clusters that neighbours span and whose members all agree.

        A cluster merges with its best partner if it is that one's best too, so no merge rests on another. The larger
        takes the other's members in; of equals, the older.
        """
        s, judge = self.settings, self.judge
        held = state.where(F.col("outcome").isin(*ACCEPTED)).join(going, "block", "left_semi").select("block", "id", "cluster")
        spans = self.pairs.join(store.dealt(held), "id").join(store.dealt(held.select(F.col("id").alias("other"), F.col("cluster").alias("beside"))), "other").where("cluster < beside").select("block", "cluster", "beside").distinct()
        some = self.evidence(state)
        rows = spans.join(store.dealt(some.select("cluster", F.col("b").alias("a"))), "cluster").join(store.dealt(some.select(F.col("cluster").alias("beside"), "b")), "beside")
        said = rows.groupBy("block", "cluster", "beside").agg(F.min(judge.alike(F.col("a"), F.col("b"))).alias("least"))
        same = (F.col("least") >= judge.same_at) & (judge.sure(F.col("least")) >= s.merge_review_floor)
        tried = self.save(said.where(same).withColumn("sure", judge.sure(F.col("least"))), "merges")
        ends = tried.where(F.col("sure") >= s.merge_accept_at).select(F.explode(F.array(F.struct(F.col("cluster").alias("own"), F.col("beside").alias("partner")), F.struct(F.col("beside").alias("own"), F.col("cluster").alias("partner")))).alias("e"), "least").select("e.*", "least")
        best = ends.groupBy("own").agg(F.min(F.struct((-F.col("least")).alias("l"), F.least("own", "partner").alias("x"), F.greatest("own", "partner").alias("y"), "partner")).alias("b")).select("own", F.col("b.partner").alias("partner"))
        mutual = best.join(store.dealt(best.select(F.col("own").alias("partner"), F.col("partner").alias("own"))), ["own", "partner"]).where("own < partner")
        sizes = held.join(store.dealt(self.copies.select(F.col("head").alias("id"))), "id").groupBy("cluster").agg(F.count("*").alias("n"))
        born = state.where(F.col("outcome").isin(*ACCEPTED)).groupBy("cluster").agg(F.min(F.struct("since", "priority")).alias("born"))
        about = sizes.join(store.dealt(born), "cluster").select("cluster", F.struct((-F.col("n")).alias("n"), "born", "cluster").alias("weight"))
        chosen = mutual.join(store.dealt(about.select(F.col("cluster").alias("own"), F.col("weight").alias("w1"))), "own").join(store.dealt(about.select(F.col("cluster").alias("partner"), F.col("weight").alias("w2"))), "partner")
        moves = self.save(chosen.select(F.greatest("w1", "w2")["cluster"].alias("cluster"), F.least("w1", "w2")["cluster"].alias("into")), "moves")
        after = state.join(store.dealt(moves), "cluster", "left")
        gone = F.col("into").isNotNull()
        new = after.select("block", "id", "priority", F.when(gone, ASSIGNED).otherwise(F.col("outcome")).alias("outcome"), F.coalesce("into", "cluster").alias("cluster"), F.when(gone, "merged").otherwise(F.col("reason")).alias("reason"), "proposal", "sure", F.when(gone, iteration).otherwise(F.col("since")).alias("since"))
        detail = F.when(F.col("into").isNotNull(), "applied").when(F.col("sure") >= s.merge_accept_at, "waits").otherwise("review")
        pair = moves.select(F.least("cluster", "into").alias("cluster"), F.greatest("cluster", "into").alias("beside"), "into")
        log = tried.join(store.dealt(pair), ["cluster", "beside"], "left").select("block", F.lit("merge").alias("kind"), F.lit(iteration).alias("iteration"), F.col("cluster").alias("item"), F.col("beside").alias("cluster"), detail.alias("detail"), F.col("into").alias("other"), "sure")
        return self.save(new, "state"), log

    def moved(self, state: DataFrame, going: DataFrame, iteration: int) -> DataFrame:
        """Members of clusters of two or more go where they fit better by the judge's ``gain``, or lose a place where most members that are shown disagree."""
        s, judge = self.settings, self.judge
        held = state.where(F.col("outcome").isin(*ACCEPTED)).join(going, "block", "left_semi")
        several = held.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
        asking = self.save(held.join(store.dealt(several), "cluster", "left_semi").select("id", F.col("cluster").alias("home"), "outcome"), "asking")
        some = self.evidence(state)
        home = self.compared(asking.select("id", F.col("home").alias("cluster"), F.lit(0).alias("rank")), some).select("id", F.col("mean").alias("home_mean"), F.col("share").alias("home_share"), F.col("unclear").alias("home_unclear"))
        others = self.compared(self.shown(asking, state).join(store.dealt(asking.select("id", F.col("home").alias("cluster"))), ["id", "cluster"], "left_anti"), some).where("unclear = 0")
        best = others.groupBy("id").agg(F.max(F.struct("mean", (-F.col("rank")).alias("near"), "cluster")).alias("best"))
        rows = asking.join(store.dealt(home), "id").join(store.dealt(best), "id", "left").where("home_unclear = 0")
        better = (F.col("best.mean") >= judge.same_at) & (F.col("best.mean") > F.col("home_mean") + judge.gain) & (judge.sure(F.col("best.mean")) >= s.comparative_accept_at)
        lost = (F.col("home_share") < 0.5) & (judge.sure(F.col("home_mean")) >= s.assign_accept_at) & (F.col("outcome") != SEED)
        said = rows.where(F.coalesce(better, F.lit(False)) | lost).withColumn("goes", F.coalesce(better, F.lit(False)))
        verdict = said.select("id", F.when(F.col("goes"), ASSIGNED).otherwise(DEFERRED).alias("to_outcome"), F.when(F.col("goes"), F.col("best.cluster")).alias("to_cluster"), F.when(F.col("goes"), "reassigned").otherwise("reverify_failed").alias("to_reason"), F.when(~F.col("goes"), F.col("home")).alias("to_proposal"), F.when(F.col("goes"), judge.sure(F.col("best.mean"))).otherwise(judge.sure(F.col("home_mean"))).alias("to_sure"))
        return self.save(self.taken(state, verdict, iteration), "state")

    def ended(self, states: list[DataFrame]) -> DataFrame:
        """Per block and iteration: a digest of the state, how many items are open, and how the block ends there, if it does."""
        each = [s.groupBy("block").agg(F.bit_xor(F.xxhash64("id", "outcome", "cluster")).alias("digest"), F.count_if(F.col("outcome").isin(*OPEN)).alias("open")).withColumn("iteration", F.lit(k)) for k, s in enumerate(states)]
        every = each[0]
        for e in each[1:]:
            every = every.unionByName(e)
        own = Window.partitionBy("block").orderBy("iteration")  # as many rows of a block as iterations
        seen = F.array_contains(F.collect_list("digest").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("digest"))
        stop = F.when(F.lag("digest").over(own) == F.col("digest"), "converged").when(seen, "oscillation").when(F.col("iteration") >= self.settings.max_refine_iterations, "max_iterations")
        return every.withColumn("stop", stop)

    def run(self) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
        """(states, their ends, logs of merges)."""
        states, logs = [self.stream()], []
        while True:
            ends = self.save(self.ended(states), "ends")
            going = ends.groupBy("block").agg(F.max("stop").alias("stop")).where("stop is null").select("block")
            going = self.save(going, "going")
            if going.isEmpty():
                return states, ends, logs
            k, going = len(states), these(going)
            state = self.retried(states[-1], going, 1000 * k)
            if self.settings.consolidate:
                state, log = self.merged(state, going, 1000 * k + 1)
                logs.append(log.withColumn("iteration", F.lit(k)))
            if self.settings.reassign:
                state = self.moved(state, going, 1000 * k + 2)
            states.append(state)

    def table(self, states: list[DataFrame], ends: DataFrame, logs: list[DataFrame]) -> DataFrame:
        """All rows: members and clusters of the state that counts, merges, and the end of each block."""
        first = ends.where("stop is not null").groupBy("block").agg(F.min_by("stop", "iteration").alias("stop"), F.min("iteration").alias("last"))
        least = ends.drop("stop").join(store.dealt(first), "block").where("iteration <= last").groupBy("block", "stop", "last").agg(F.min(F.struct("open", "iteration")).alias("least"))
        chosen = self.save(least.select("block", "stop", "last", F.when(F.col("stop") == "converged", F.col("last")).otherwise(F.col("least.iteration")).alias("chosen")), "chosen")
        rows = None
        for k, s in enumerate(states):
            own = s.join(these(chosen.where(F.col("chosen") == k).select("block")), "block", "left_semi").withColumn("iteration", F.lit(k))
            rows = own if rows is None else rows.unionByName(own)
        counted = self.save(rows, "counted")
        head = counted.select(F.col("id").alias("head"), "outcome", "cluster", "reason", "proposal", "sure", "iteration", "since", F.col("priority").alias("head_priority"))
        every = self.copies.join(store.dealt(head), "head").join(store.dealt(self.items.select("id", "place", "priority")), "id")
        copy = (F.col("id") != F.col("head")) & F.col("outcome").isin(*ACCEPTED)
        members = every.select("block", F.lit("member").alias("kind"), "iteration", F.col("id").alias("item"), "cluster", F.when(copy, ASSIGNED).otherwise(F.col("outcome")).alias("outcome"), F.when(copy, "same_text").otherwise(F.col("reason")).alias("detail"), F.col("proposal").alias("other"), "sure", "place", F.struct("since", "head_priority", "head", copy.alias("copy"), "id").alias("age"))
        members = self.save(members, "members")
        groups = members.where(F.col("outcome").isin(*ACCEPTED)).groupBy("block", "iteration", "cluster").agg(F.count("*").alias("size"), F.min_by("item", "age").alias("item"), F.min("age").alias("born"), F.max("age.since").alias("revision"))
        clusters = groups.select("block", F.lit("cluster").alias("kind"), "iteration", "item", "cluster", F.lit("neighbours_exhausted").alias("detail"), F.col("size").cast("int").alias("place"), F.col("revision").cast("int").alias("revision"))
        done = chosen.select("block", F.lit("end").alias("kind"), F.col("last").alias("iteration"), F.lit("").alias("item"), F.col("stop").alias("detail"), F.col("chosen").alias("place"))
        out = members.drop("age").unionByName(clusters, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)
        for log in logs:
            out = out.unionByName(log, allowMissingColumns=True)
        return self.save(out, "log")


def these(blocks: DataFrame) -> DataFrame:
    """Some blocks, to be met by items: broadcast if they are counted to be few."""
    return F.broadcast(blocks) if store.is_few(blocks, BLOCKS) else store.dealt(blocks)


def clipped(label: Column, chars: int) -> Column:
    """One line of a text, of so many characters at most."""
    line = F.trim(F.regexp_replace(label, r"\s+", " "))
    return F.when(F.length(line) <= chars, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, chars - 3)), F.lit("...")))


def placed(items: DataFrame) -> DataFrame:
    """``items`` with ``place`` in their block's order and ``priority``: ranges of the order are ranked alone, and placed by their sizes."""
    ranged = store.Work(items.sparkSession, "places").save(items.repartitionByRange("block", "sort", "id").withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("block", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("block", "range").orderBy("sort", "id")) - 1
    first = sizes.select("block", "range", before.alias("before"))
    rows = ranged.withColumn("rank", rank).join(store.dealt(first), ["block", "range"])
    return rows.select("block", "id", "label", "form", (F.col("rank") + F.col("before")).cast("int").alias("place"), F.xxhash64(F.lit("turn"), "id").alias("priority"))


def read_items(items: DataFrame, block: Column, settings: Settings) -> DataFrame:
    label = F.coalesce(F.col("label"), F.lit(""))
    sort = tx.order_key(label) if settings.order == "label" or "place" not in items.columns else F.lpad(F.col("place").cast("string"), 20, "0")
    return items.select(F.col("id").cast("string").alias("id"), label.alias("label"), sort.alias("sort"), F.coalesce(block.cast("string"), F.lit("")).alias("block"), tx.order_key(label).alias("form"))


def cluster_blocks(items: DataFrame, block: Column, judge: Callable[[], Judge] = lexical_judge, settings: Settings = Settings(), run: str = "run") -> DataFrame:
    """The rows of a run over ``id`` and ``label``, each ``block`` by itself."""
    own = Run(read_items(items, block, settings), judge(), settings, run)
    return own.table(*own.run())


def resumed(items: DataFrame, block: Column, log: DataFrame, judge: Callable[[], Judge] = lexical_judge, settings: Settings = Settings(), run: str = "run") -> DataFrame:
    """``log`` with its failed items decided anew from the state that counts; nothing else of it changes."""
    own = Run(read_items(items, block, settings), judge(), settings, run)
    members = log.where("kind = 'member'").select(F.col("item").alias("id"), "outcome", "cluster", F.col("detail").alias("reason"), F.col("other").alias("proposal"), "sure")
    state = own.save(own.lines.join(store.dealt(members), "id").select("block", "id", "priority", "outcome", "cluster", "reason", "proposal", "sure", F.when(F.col("outcome") == SEED, 0).otherwise(1).alias("since")), "state")
    every = these(own.save(state.select("block").distinct(), "going"))
    after = own.retried(state, every, 2, (FAILED,))
    ends = own.ended([after]).withColumn("stop", F.lit("resumed"))
    return own.table([after], ends, [])


def selected_members(log: DataFrame) -> DataFrame:
    """Items of the state that counts, with exported outcomes: a lone member is a singleton, open items need review or failed."""
    size = log.where("kind = 'cluster'").select("block", "cluster", F.col("place").alias("cluster_size"))
    found = log.where("kind = 'member'").join(store.dealt(size), ["block", "cluster"], "left")
    accepted = F.col("outcome").isin(*ACCEPTED)
    outcome = F.when(accepted & (F.col("cluster_size") > 1), "assigned").when(accepted, "singleton").when(F.col("outcome") == DEFERRED, "needs_review").otherwise("failed")
    reason = F.when(accepted & (F.col("cluster_size") == 1) & (F.col("outcome") != SEED), "lone_member").otherwise(F.col("detail"))
    return found.select("block", F.col("place").alias("order_index"), F.col("item").alias("source_id"), outcome.alias("outcome"), F.when(accepted, F.col("cluster")).alias("cluster_id"), F.when(accepted, F.col("cluster_size")).alias("cluster_size"), reason.alias("reason"), F.col("other").alias("proposal_cluster_id"), F.col("sure").alias("confidence"))


def selected_clusters(log: DataFrame) -> DataFrame:
    """Clusters of the state that counts, with their members in order. The list of members is what a cluster's row is for: large ones have long rows."""
    listed = log.where("kind = 'member' AND cluster is not null AND outcome in ('seed', 'assigned')").groupBy("block", "cluster").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("m"))
    rows = log.where("kind = 'cluster'").select("block", "cluster", "revision", F.col("place").alias("size"), F.col("item").alias("seed_id"), F.col("detail").alias("mint_provenance")).join(store.dealt(listed), ["block", "cluster"])
    order = F.get("m", F.lit(0))["place"]
    return rows.select("block", F.col("cluster").alias("cluster_id"), "revision", "size", F.when(F.col("size") > 1, "verified").otherwise("singleton").alias("status"), "seed_id", "mint_provenance", F.array_join(F.transform("m", lambda x: x["item"]), "|").alias("member_ids"), order.alias("created_seq"))


def unresolved(members: DataFrame) -> DataFrame:
    return members.where(F.col("outcome").isin("needs_review", "failed", "pending"))


def partition_faults(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Accepted items that aren't in exactly the cluster that names them; none, if the clusters are a partition."""
    listed = clusters.select("block", "cluster_id", F.explode(F.split("member_ids", r"\|")).alias("source_id")).withColumn("listed", F.lit(1))
    accepted = members.where("cluster_id is not null").select("block", "source_id", "cluster_id").withColumn("placed", F.lit(1))
    both = accepted.join(listed, ["block", "source_id", "cluster_id"], "full")
    return both.groupBy("block", "source_id").agg(F.sum("placed").alias("placed"), F.sum("listed").alias("listed")).where("coalesce(placed, 0) <> 1 or coalesce(listed, 0) <> 1")


def run_summary(log: DataFrame) -> DataFrame:
    """Per block: how it ended, its iterations, clusters, and open items."""
    ends = log.where("kind = 'end'").select("block", F.col("detail").alias("stop_reason"), F.col("place").alias("selected"), (F.col("iteration") + 1).alias("states"))
    members = selected_members(log).groupBy("block").agg(F.count("*").alias("items"), F.count_if(F.col("outcome").isin("needs_review", "failed")).alias("open"), F.count_distinct("cluster_id").alias("clusters"))
    steps = log.where("kind = 'merge'").groupBy("block").agg(F.count_if(F.col("detail") == "applied").alias("merges"))
    return ends.join(store.dealt(members), "block").join(store.dealt(steps), "block", "left").withColumn("merges", F.coalesce("merges", F.lit(0)))


def warnings(log: DataFrame, high_open: float = 0.5) -> DataFrame:
    """Blocks that a reader should look at: ``unresolved_share``, ``not_converged``, ``all_singletons``, ``single_cluster``."""
    s = run_summary(log)
    codes = F.array(
        F.when(F.col("open") / F.col("items") >= high_open, "unresolved_share"), F.when(F.col("stop_reason") != "converged", "not_converged"),
        F.when((F.col("items") > 1) & (F.col("clusters") == F.col("items")), "all_singletons"), F.when((F.col("items") > 2) & (F.col("clusters") == 1), "single_cluster"),
    )
    return s.select("block", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))
