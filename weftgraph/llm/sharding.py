"""Sharding by balanced label propagation (operator 1), law `rows`: shard sizes in rows differ by one at most.

Documents that share a link key are linked; labels are shards. In each round a join gives every linked document the votes of
its links' members by shard, and it asks to move to the shard with most of them. Flows between shards are then cut on the
driver (a matrix of number x number counts) until no shard takes in more than its free quota and what leaves it, and each
flow accepts that share of its documents, whole links where they are small. Rounds end when no document may move, or when
the number of linked pairs within shards has not grown by the share `gain` for `patience` rounds; the best round counts. Documents without links
have no preference: they fill the shards to the quotas exactly, as do those beyond a quota.

Null texts count as empty: 16 bytes, one group. Null keys are ordinary rows. Repeated rows are placed each; equally good shards
of a link go by a hash of link and shard, alike for all its members. An empty table gives no rows. With fewer rows than
shards, the first shards hold one each. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import ranked, skew_join, stored, table
from weftgraph.operators.ranking import indexed


@dataclass(frozen=True)
class Shards:
    """gain, patience: propagation ends when linked pairs within shards have not grown by this share for so many rounds."""

    number: int = 40
    gain: float = 0.01
    patience: int = 3
    seed: int = 17


def quotas(rows: int, number: int) -> list[int]:
    return [rows // number + (s < rows % number) for s in range(number)]


def unit(*columns: Column | str) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def spare(n: float) -> float:
    """Two standard deviations of n accepted by chance, a quarter of n at most."""
    return min(2 * n**0.5, n / 4)


def allowed(asks: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """The share of each flow (from, to) that may move: inflow stays within room and accepted outflow."""
    flow = {k: float(n) for k, n in asks.items()}
    for _ in range(300):
        into, out = Counter(), Counter()
        for (a, b), n in flow.items():
            into[b] += n
            out[a] += n
        over = {b: max(0.0, room[b] + out[b]) / n for b, n in into.items() if n > room[b] + out[b] + 0.5}
        if not over:
            break
        for a, b in flow:
            if b in over:
                flow[a, b] *= over[b]
    # documents are accepted by chance: a cut flow leaves two standard deviations free, which the next round can use
    return {k: flow[k] / n if flow[k] > n - 0.5 else (flow[k] - spare(flow[k])) / n for k, n in asks.items()}


def votes(state: DataFrame, links: DataFrame, number: int) -> DataFrame:
    """(link, s0, s1 ..): a link's members by shard; a fraction that hangs on link and shard breaks ties alike for all members."""
    count = links.join(state, "id").groupBy("link").pivot("shard", list(range(number))).count()
    return count.select("link", *((F.coalesce(F.col(str(s)), F.lit(0)) + unit("link", F.lit(s)) / 2).alias(f"s{s}") for s in range(number)))


def inner_pairs(score: DataFrame, number: int) -> float:
    """Linked pairs within shards, by votes()."""
    held = [F.floor(f"s{s}").cast("double") for s in range(number)]
    return score.agg(F.sum(sum((n * (n - 1) / 2 for n in held), F.lit(0.0)))).first()[0] or 0.0


def propagated(ids: DataFrame, links: DataFrame, quota: list[int], plan: Shards) -> DataFrame:
    """(id, shard) of linked documents. ids: stored distinct id; links: stored (id, link), several links a document at will.

    Hot links are joined by a bounded broadcast, and votes are pre-aggregated, so that no task holds a link.
    """
    number = plan.number
    state = stored(ids.select("id", F.pmod(F.xxhash64("id", F.lit(plan.seed)), F.lit(number)).cast("int").alias("shard")), "labels")
    rows = links.count()
    best, most, goal, waits, turn = state, -1.0, 0.0, 0, 0
    while True:
        held = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
        room = [q - held.get(s, 0) for s, q in enumerate(quota)]
        score = stored(votes(state, links, number), "votes")
        inner = inner_pairs(score, number)
        waits = 0 if inner >= goal else waits + 1
        if inner >= goal:
            goal = inner * (1 + plan.gain) + 1
        if inner > most:
            best, most = state, inner
        if waits >= plan.patience:
            return best
        # sums a shard, so that a document's links aren't gathered
        heard = skew_join(links, score, "link", rows, "inner").groupBy("id").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(number)), F.min("link").alias("_link"))
        total = F.array(*(f"s{s}" for s in range(number)))
        # a full shard attracts nobody: others look for the best one with room, and leave a full one for as many votes
        # large links pass by shards that are nearly full, or they would fill the rest of one by ever smaller flows
        any_room, much_room = (F.array(*(F.lit(1.0 if r > least(q) else 0.0) for r, q in zip(room, quota, strict=True))) for least in (lambda q: 0, spare))
        members = F.aggregate("_score", F.lit(0.0), lambda a, x: a + x)
        open_ = F.when(members * 4 < max(quota), any_room).otherwise(much_room)
        scored = heard.select("id", "_link", total.alias("_score")).join(state, "id")
        reach = F.zip_with("_score", open_, lambda x, o: x * o)
        asks = scored.select("id", "_link", "shard", "_score", reach.alias("_reach")).select(
            "id", "_link", F.col("shard").alias("_from"), (F.element_at("_score", F.col("shard") + 1) - (1 - F.element_at(open_, F.col("shard") + 1)) / 2).alias("_now"), F.array_max("_reach").alias("_best"), (F.array_position("_reach", F.array_max("_reach")) - 1).cast("int").alias("_to")
        )
        moves = stored(asks.where((F.col("_best") > F.col("_now")) & (F.col("_to") != F.col("_from")) & (F.col("_best") >= 1)), "moves")
        flow = {(r["_from"], r["_to"]): r["count"] for r in moves.groupBy("_from", "_to").count().collect()}
        shares = allowed(flow, room)
        if sum(flow[k] * s for k, s in shares.items()) < 1:
            return best
        luck = F.when(F.col("_best") * 8 < max(quota), unit("_link", F.lit(turn))).otherwise(unit("id", F.lit(turn)))
        share = F.element_at(F.create_map(*(F.lit(x) for (a, b), s in sorted(shares.items()) for x in (a * number + b, s))), F.col("_from") * number + F.col("_to"))
        accepted = moves.where(luck < share).select("id", "_to")
        state = stored(state.join(accepted, "id", "left").select("id", F.coalesce("_to", "shard").alias("shard")), "labels")
        turn += 1


def balanced_shards(rows: DataFrame, links: DataFrame, total: int, plan: Shards = Shards(), group: str | None = None) -> DataFrame:
    """rows, stored and with a distinct id, get shard and slot: every shard holds its quota of rows, slots are gapless from 0.

    links: stored (id, link). group: a column of rows by which rows of a shard beyond its quota are chosen together.
    """
    quota = quotas(total, plan.number)
    ids = links.select("id").distinct()
    state = propagated(stored(ids, "linked"), links, quota, plan)
    # members of large links come last in a shard, so that what is beyond its quota is theirs; such links are a bounded number
    large = links.groupBy("link").count().where(F.col("count") * 8 > max(quota)).select("link")
    large = links.join(F.broadcast(large), "link", "left_semi").select("id").distinct().withColumn("_large", F.lit(1))
    placed = rows.join(state, "id", "left").join(large, "id", "left").withColumn("_spread", F.xxhash64(group or "id"))
    placed = stored(placed, "placed")
    first = {r["shard"]: r["count"] for r in placed.where("shard is not null and _large is null").groupBy("shard").count().collect()}
    begin = F.element_at(F.array(*(F.lit(first.get(s, 0)) for s in range(plan.number))), F.col("shard") + 1)
    small = ranked(placed.where("shard is not null and _large is null"), "shard", "id", total, "slot")
    settled = small.unionByName(ranked(placed.where("shard is not null and _large = 1"), "shard", "id", total, "slot").withColumn("slot", F.col("slot") + begin)).drop("_large")
    placed = placed.drop("_large")
    limit = F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1)
    settled = stored(settled, "settled")
    held = {r["shard"]: r["count"] for r in settled.where(F.col("slot") < limit).groupBy("shard").count().collect()}
    free = [q - held.get(s, 0) for s, q in enumerate(quota)]
    begins = [sum(free[:s]) for s in range(plan.number)]
    # rows over a quota come first, links together (sorted by ranges, so that no task holds a link), then those without a link
    over = settled.where(F.col("slot") >= limit).drop("slot", "shard")
    loose = placed.where("shard is null").drop("shard").withColumn("_all", F.lit(0))
    over = indexed(over, "_spread", "id", out="_k")
    beyond = over.count()
    pool = over.unionByName(ranked(loose, "_all", "id", total, "_k").drop("_all").withColumn("_k", F.col("_k") + beyond))
    # the last shard that begins at or before k and has room
    shard = F.size(F.filter(F.array(*map(F.lit, (b for b, f in zip(begins, free, strict=True) if f))), lambda b: b <= F.col("_k")))
    with_room = [s for s, f in enumerate(free) if f] or [0]
    pool = pool.withColumn("shard", F.element_at(F.array(*map(F.lit, with_room)), shard).cast("int"))
    slot = F.col("_k") - F.element_at(F.array(*map(F.lit, begins)), F.col("shard") + 1) + F.element_at(F.array(*(F.lit(held.get(s, 0)) for s in range(plan.number))), F.col("shard") + 1)
    pool = pool.withColumn("slot", slot.cast("long")).drop("_k")
    return settled.where(F.col("slot") < limit).unionByName(pool.select(settled.columns)).drop("_spread")


def sharded_documents(docs: DataFrame, plan: Shards = Shards(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, shard and slot of every document; documents with equal texts are linked."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.sha2(t, 256).alias("link"))
    base = stored(base.withColumn("id", F.monotonically_increasing_id()), "rows")
    total = base.count()
    groups = base.groupBy("link").count().where("count > 1").select("link")
    links = stored(skew_join(base, stored(groups, "groups"), "link", total, "inner").select("id", "link"), "links")
    return balanced_shards(base, links, total, plan, "link").drop("link", "id")


def op1_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
