"""Spatial predicates, auctions, utilities and state machines of agent tables (AGT-*)."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.draws import uniform
from lodestone.plans.storage import stored


#: Rows of a grid cell, of the left and of the right side, beyond which it is split; for pairs, and where they are only counted.
PAIR_CELL, COUNT_CELL = (4096, 4096), (65_536, 1_000_000)


def _cells(left: DataFrame, right: DataFrame, distance: float, most: tuple[int, int]) -> tuple[DataFrame, DataFrame, list[str], int]:
    """(left, right, keys, partitions): rows with x and y that may be nearer than ``distance`` meet in one value of the keys, each pair once.

    The keys are a grid cell and a part of each side's rows in it, so that no value has more than about
    ``most`` rows. The number of partitions follows the pairs to compare; rows may be few where pairs are many.
    """
    cell = lambda c: F.floor(F.col(c) / distance)
    finite = "abs(x) < double('Infinity') AND abs(y) < double('Infinity')"
    around = lambda c: F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)]))
    a = left.filter(finite).withColumns({"gx": cell("x"), "gy": cell("y")})
    b = right.filter(finite).withColumns({"gx": cell("x"), "gy": cell("y")}).withColumn("gx", around("gx")).withColumn("gy", around("gy"))
    count = lambda side, name: side.groupBy("gx", "gy").agg(F.count("*").alias(name))
    sizes = stored(count(a, "na").join(count(b, "nb"), ["gx", "gy"]))
    pairs = sizes.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0
    crowded = sizes.filter((F.col("na") > most[0]) | (F.col("nb") > most[1])).select("gx", "gy", F.ceil(F.col("na") / most[0]).alias("pa"), F.ceil(F.col("nb") / most[1]).alias("pb"))
    part = lambda own, n: F.pmod(F.xxhash64(*own), F.coalesce(n, F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    met = lambda side: side.join(F.broadcast(crowded), ["gx", "gy"], "left")
    a, b = met(a).withColumn("ka", part(left.columns, F.col("pa"))).withColumn("kb", every(F.col("pb"))), met(b).withColumn("kb", part(right.columns, F.col("pb"))).withColumn("ka", every(F.col("pa")))
    wanted = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.drop("pa", "pb"), b.drop("pa", "pb"), ["gx", "gy", "ka", "kb"], max(wanted, min(int(pairs / 16e6), 10_000))


def within(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """(l_id, r_id, dist) of pairs of (id, x, y) rows nearer than ``distance``, by a join on grid cells of that size, crowded ones in parts."""
    a, b, keys, n = _cells(left.select("id", "x", "y"), right.select("id", "x", "y"), distance, PAIR_CELL)
    a, b = a.withColumnsRenamed({"id": "l_id", "x": "lx", "y": "ly"}).repartition(n, *keys), b.withColumnsRenamed({"id": "r_id", "x": "rx", "y": "ry"})
    dist = F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
    return a.join(b, keys).withColumn("dist", dist).filter(F.col("dist") < distance).select("l_id", "r_id", "dist")


def _disc_counts(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, distance: float, step: int = 16_384) -> np.ndarray:
    """How many of the points (rx, ry) are nearer than ``distance`` to each (lx, ly).

    Points are sorted by the cells of a fine grid. Row after row of cells, those that lie whole in the disc
    are counted by their bounds in that order, and only the points of the others are measured.
    """
    ox, oy = rx.min(), ry.min()
    area = max(np.ptp(rx), distance) * max(np.ptp(ry), distance)
    size = min(max((area / len(rx)) ** 0.5, distance / 256), distance)
    cols, rows = (int(np.ptp(v) // size) + 1 for v in (rx, ry))
    cell = ((ry - oy) // size).astype(np.int64) * cols + ((rx - ox) // size).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    px, py = rx[order], ry[order]
    start = np.searchsorted(cell[order], np.arange(rows * cols + 1))
    out = np.zeros(len(lx), np.int64)
    for a in range(0, len(lx), step):
        x, y = lx[a : a + step] - ox, ly[a : a + step] - oy
        own, first = np.zeros(len(x), np.int64), np.floor((y - distance) / size).astype(np.int64) - 1
        for k in range(int(2 * distance / size) + 4):
            row = first + k
            low, high = row * size - y, (row + 1) * size - y
            near, far = np.maximum(np.maximum(low, -high), 0), np.maximum(np.abs(low), np.abs(high))
            at = np.flatnonzero((row >= 0) & (row < rows) & (near < distance * (1 + 1e-9)))
            if not len(at):
                continue
            x_, base = x[at], row[at] * cols
            wide = np.sqrt(np.maximum(distance**2 * (1 + 1e-9) - near[at] ** 2, 0))
            inner = np.sqrt(np.maximum(distance**2 - far[at] ** 2, 0))
            lo, hi = np.floor((x_ - wide) / size - 1e-6), np.floor((x_ + wide) / size + 1e-6) + 1
            inlo, inhi = np.ceil((x_ - inner) / size + 1e-6), np.floor((x_ + inner) / size - 1e-6)
            inlo, inhi = np.where(inlo < inhi, inlo, hi), np.where(inlo < inhi, inhi, hi)
            lo, inlo, inhi, hi = (start[base + np.clip(v, 0, cols).astype(np.int64)] for v in (lo, inlo, inhi, hi))
            own[at] += inhi - inlo
            begin, n = np.r_[lo, inhi], np.r_[inlo - lo, hi - inhi]
            who = np.repeat(np.r_[at, at], n)
            if len(who):
                there = np.arange(len(who)) + np.repeat(begin - np.cumsum(n) + n, n)
                hit = np.sqrt((lx[a + who] - px[there]) ** 2 + (ly[a + who] - py[there]) ** 2) < distance
                own += np.bincount(who[hit], minlength=len(own))
        out[a : a + step] = own
    return out


def trait_counts_within(left: DataFrame, right: DataFrame, distance: float, trait: str) -> DataFrame:
    """(l_id, trait, n) as ``trait_counts`` of the pairs ``within`` a distance, of which none is made: of the right side's rows, those in the midst of a disc are counted cell by cell."""
    a, b, keys, n = _cells(left.select("id", "x", "y"), right.select("x", "y", F.col(trait).alias("trait")), distance, COUNT_CELL)
    a, b = (side.withColumns({c: F.col(c).cast("double") for c in "xy"}).repartition(n, *keys) for side in (a, b))
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((a, "id"), (b, "trait"))}

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], mine.schema.field("id").type), pa.array([], theirs.schema.field("trait").type), pa.array([], pa.int64())], ["l_id", "trait", "n"])]
        if mine.num_rows and theirs.num_rows:
            lx, ly, rx, ry = (t[c].to_numpy() for t in (mine, theirs) for c in "xy")
            found = theirs["trait"].combine_chunks().dictionary_encode(null_encoding="encode")
            code = found.indices.to_numpy(zero_copy_only=False)
            for k in range(len(found.dictionary)):
                n = _disc_counts(lx, ly, rx[code == k], ry[code == k], distance)
                at = pa.array(np.flatnonzero(n))
                out.append(pa.table([mine["id"].take(at), found.dictionary.take(pa.array([k] * len(at), pa.int64())), pa.array(n).take(at)], out[0].column_names))
        return pa.concat_tables(out)

    counted = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, f"l_id {kinds['id']}, trait {kinds['trait']}, n long")
    return counted.groupBy("l_id", "trait").agg(F.sum("n").alias("n"))


#: Rows up to which the right side of a nearest-row or best-row search is sent whole to every task (about 60 bytes each, 60 MB).
SMALL_SIDE = 1_000_000


def nearest(left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    """(l_id, r_id): the nearest row of the right side; of equal distances the lesser id.

    Rows meet in grid cells: first the nine around a row, then rings of cells that are twice as large,
    until what was found is nearer than the cells that weren't looked at. ``cell`` is the first size, by
    default that at which a cell holds about one row of the right side.
    """
    rows = left.select(F.col("id").alias("l_id"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    spots = stored(right.select(F.col("id").alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry")))
    span = spots.agg(F.count("*").alias("n"), (F.max("rx") - F.min("rx")).alias("w"), (F.max("ry") - F.min("ry")).alias("h"), F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry")).first()
    if not span["n"]:
        return rows.select("l_id", F.lit(None).cast(right.schema["id"].dataType).alias("r_id")).limit(0)
    reach = rows.agg(F.max(F.greatest(F.abs(F.col("lx") - span["min(rx)"]), F.abs(F.col("lx") - span["max(rx)"]), F.abs(F.col("ly") - span["min(ry)"]), F.abs(F.col("ly") - span["max(ry)"])))).first()[0] or 0.0
    size = cell or max((span["w"] * span["h"] / span["n"]) ** 0.5, (span["w"] + span["h"]) / span["n"], 1e-9)
    open_, done = rows, None
    while True:
        at = lambda c, size=size: F.floor(F.col(c) / size)
        near = open_.withColumn("gx", F.explode(F.array(*[at("lx") + i for i in (-1, 0, 1)]))).withColumn("gy", F.explode(F.array(*[at("ly") + i for i in (-1, 0, 1)])))
        met = near.join(spots.withColumns({"gx": at("rx"), "gy": at("ry")}), ["gx", "gy"])
        far = F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))
        best = met.groupBy("l_id", "lx", "ly").agg(F.min(F.struct(far.alias("far"), "r_id")).alias("m"))
        sure = stored(best.filter(F.col("m.far") <= size))  # what lies outside the nine cells is farther than one
        done = sure if done is None else done.unionByName(sure)
        left_over = stored(open_.join(sure.select("l_id"), "l_id", "left_anti"))
        if size > reach or left_over.isEmpty():
            break
        open_, size = left_over, size * 2
    return done.select("l_id", F.col("m.r_id").alias("r_id"))


def trait_counts(pairs: DataFrame, traits: DataFrame, trait: str) -> DataFrame:
    """(l_id, trait, n): how many of the agents near each have each trait."""
    return pairs.join(traits.select(F.col("id").alias("r_id"), F.col(trait).alias("trait")), "r_id").groupBy("l_id", "trait").agg(F.count("*").alias("n"))


def some_of(items: Column, k: int, seed: int = 1) -> Column:
    """k elements at random, without repetition."""
    keyed = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), x.cast("string")).cast("binary")).alias("k"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["x"])


def coin(seed: int, *columns: Column, p: float = 0.5) -> Column:
    """True with probability p, the same for the same columns."""
    return uniform(seed, *columns) < p


def uniform_int(low: int, high: int, seed: int, *columns: Column) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(uniform(seed, *columns) * (high - low + 1)) + low).cast("long")


def best_scene(guests: DataFrame, scenes: DataFrame, traits: list[str], leader: int | None = None, crowd: float = 0.5) -> DataFrame:
    """(guest, scene, utility): the scene of the greatest dot product of traits; of equals the one of least id.

    With a leader's scene, guests (id, crowd, traits) that like crowds less than ``crowd`` choose among the
    other scenes, and the others have no choice of their own and no row. Scenes are sent to every task, so
    more than SMALL_SIDE of them are refused; a guest's row is reduced to its best scene where it is read.
    """
    if scenes.count() > SMALL_SIDE:
        raise ValueError(f"more than {SMALL_SIDE} scenes")
    if leader is not None:
        guests, scenes = guests.filter(F.col("crowd") < crowd), scenes.filter(F.col("id") != leader)
    held = scenes.agg(F.collect_list(F.struct("id", *traits)).alias("_scenes")).filter(F.size("_scenes") > 0)
    utility = lambda s: reduce(add, [F.col(t) * s[t] for t in traits])
    best = F.array_max(F.transform("_scenes", lambda s: F.struct(utility(s).alias("utility"), (-s["id"]).alias("scene"))))
    own = guests.repartition("id").crossJoin(F.broadcast(held)).select(F.col("id").alias("guest"), best.alias("m"))
    return own.groupBy("guest").agg(F.max("m").alias("m")).select("guest", (-F.col("m.scene")).alias("scene"), "m.utility")


def dutch_auction(auctions: DataFrame, bids: DataFrame, step: float = 10.0) -> DataFrame:
    """(auction, winner, price): the price falls by ``step`` from (auction, start, least) until a bidder's limit meets it.

    bids are (auction, bidder, max_price, place); of those that meet the price first the one of lowest
    place wins. Without a taker down to ``least``, winner and price are null.
    """
    top = auctions.join(bids.groupBy("auction").agg(F.max("max_price").alias("top")), "auction", "left")
    rounds = F.greatest(F.ceil((F.col("start") - F.col("top")) / step), F.lit(0))
    priced = top.withColumn("price", F.col("start") - rounds * step).withColumn("price", F.when(F.col("top").isNotNull() & (F.col("price") >= F.col("least")), F.col("price")))
    took = priced.join(bids, "auction").filter("max_price >= price").groupBy("auction").agg(F.min_by("bidder", F.struct("place", "bidder")).alias("winner"))
    return priced.join(took, "auction", "left").select("auction", "winner", "price")


def first_price(bids: DataFrame) -> DataFrame:
    """(auction, winner, price): the highest bid, of equals the earliest place."""
    return bids.groupBy("auction").agg(F.max_by(F.struct("bidder", "bid"), F.struct("bid", -F.col("place"))).alias("m")).select("auction", F.col("m.bidder").alias("winner"), F.col("m.bid").alias("price"))


def second_price(bids: DataFrame) -> DataFrame:
    """(auction, winner, price): the highest bidder pays the second bid, its own where there is no other."""
    w = Window.partitionBy("auction").orderBy(F.desc("bid"), "place")
    ranked = bids.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    return ranked.groupBy("auction").agg(F.min_by("bidder", "r").alias("winner"), F.max_by("bid", "r").alias("price"))


def bid_rule(kind: Column, interests: Column, item: Column, limit: Column, price: Column) -> Column:
    """What a bidder offers: nothing for an item of no interest, the asked price in a falling auction, its limit when sealed."""
    return F.when(~F.array_contains(interests, item), F.lit(None)).when(kind == "dutch", F.when(limit >= price, price)).otherwise(limit)


def _threat(column: Column):
    return lambda x, i: (x == F.col("r")) | (F.abs(x - F.col("r")) == column - i)


def queens(spark, n: int) -> DataFrame:
    """(rows): every way to set n queens, the row of each column, by n joins on columns and diagonals."""
    row = spark.range(n).select(F.col("id").cast("int").alias("r"))
    board = row.select(F.array("r").alias("rows"))
    for c in range(1, n):
        column = F.lit(c)
        free = ~F.exists(F.transform("rows", _threat(column)), lambda b: b)
        board = board.crossJoin(F.broadcast(row)).filter(free).select(F.concat("rows", F.array("r")).alias("rows"))
    return board


def perceived(agents: DataFrame, things: DataFrame, distance: float, belief: Column) -> DataFrame:
    """(agent, belief): what each agent (id, x, y) takes in of the things (id, x, y, ...) in its reach for which the belief isn't null."""
    named = things.withColumn("belief", belief).filter("belief IS NOT NULL")
    return trait_counts_within(agents, named, distance, "belief").select(F.col("l_id").alias("agent"), F.col("trait").alias("belief"))


def intentions(beliefs: DataFrame, rules: DataFrame) -> DataFrame:
    """(agent, desire, strength): the strongest desire that an agent's beliefs call up; of equals the first by name."""
    wanted = beliefs.join(rules, "belief").groupBy("agent").agg(F.min(F.struct((-F.col("strength")).alias("s"), "desire")).alias("m"))
    return wanted.select("agent", "m.desire", (-F.col("m.s")).alias("strength"))


def hunger_step(agents: DataFrame, hungry: float = 50.0, rate: float = 1.0) -> DataFrame:
    """One step of (id, hunger, thirst, state): counters fall, and below the threshold the lower one sets the way."""
    fallen = agents.withColumns({"hunger": F.greatest(F.col("hunger") - rate, F.lit(0.0)), "thirst": F.greatest(F.col("thirst") - rate, F.lit(0.0))})
    low = F.least("hunger", "thirst") < hungry
    return fallen.withColumn("state", F.when(low & (F.col("hunger") <= F.col("thirst")), "food").when(low, "drink").otherwise("dance"))


def run_steps(agents: DataFrame, steps: int, step=hunger_step, cut_every: int = 10) -> DataFrame:
    """The table after a number of steps."""
    for i in range(steps):
        agents = step(agents)
        if (i + 1) % cut_every == 0:
            agents = stored(agents)
    return agents


def step_metrics(agents: DataFrame, step: int) -> DataFrame:
    """(step, state, n, utility) of agents (id, state, roaming): how many are in each state, and the mean of 1 / (roaming + 1)."""
    return agents.groupBy("state").agg(F.count("*").alias("n"), F.avg(1 / (F.col("roaming") + 1)).alias("utility")).select(F.lit(step).alias("step"), "state", "n", "utility")


def destination(agents: DataFrame, places: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(id, place): of the places (id, kind, x, y) of the kind that an agent's state asks for the one that it remembers, else the nearest."""
    out = None
    for (kind,) in places.select("kind").distinct().orderBy("kind").collect():  # a few kinds
        own = nearest(agents.filter(F.col("state") == kind), places.filter(F.col("kind") == kind)).select(F.col("l_id").alias("id"), F.col("r_id").alias("place"))
        out = own if out is None else out.unionByName(own)
    if memory is None:
        return out
    return out.join(memory.select("id", F.col("place").alias("_known")), "id", "left").select("id", F.coalesce("_known", "place").alias("place"))


def parity_grid(spark, width: int, height: int) -> DataFrame:
    """(x, y, dark) of a board."""
    return spark.range(width).withColumnRenamed("id", "x").crossJoin(spark.range(height).withColumnRenamed("id", "y")).withColumn("dark", F.pmod(F.col("x") + F.col("y"), F.lit(2)) == 1)


def messages_for(messages: DataFrame, performative: str, receiver: str | None = None) -> DataFrame:
    found = messages.filter(F.col("performative") == performative)
    return found if receiver is None else found.filter(F.col("receiver") == receiver)


def pick_member(registry: DataFrame, kind: str, seed: int = 1) -> DataFrame:
    """One member of a category, at random but the same for a seed."""
    return registry.filter(F.col("kind") == kind).orderBy(uniform(seed, F.col("id")), "id").limit(1)


def without_caught(agents: DataFrame, bad: DataFrame, guards: DataFrame, distance: float) -> DataFrame:
    """agents without the bad ones that a guard has in reach."""
    caught = trait_counts_within(bad, guards.withColumn("trait", F.lit(1)), distance, "trait").select(F.col("l_id").alias("id"))
    return agents.join(caught, "id", "left_anti")


def followed(agents: DataFrame, choices: DataFrame, crowd: float = 0.3) -> DataFrame:
    """agents (id, crowd, choice) after the leader's latest choice (ts, choice): those that like crowds take it."""
    last = choices.agg(F.max_by("choice", "ts").alias("_lead"))
    return agents.crossJoin(F.broadcast(last)).withColumn("choice", F.when((F.col("crowd") > crowd) & F.col("_lead").isNotNull(), F.col("_lead")).otherwise(F.col("choice"))).drop("_lead")


def resets(step: Column, every: int | None = None, p: float = 0.0, seed: int = 1, *keys: Column) -> Column:
    """Whether something starts anew at a step: every so many of them, or with probability p by a draw from the keys and the step."""
    due = F.pmod(step, F.lit(every)) == 0 if every else F.lit(False)
    return due | (uniform(seed, step, *keys) < p) if p else due


def scene_decision(music: Column, traits: Column, food: Column, crowd: Column, meat: Column, vegetarian: Column, vegan: Column, coin: Column) -> Column:
    """What a guest does on hearing of a scene: "go" there, "leave" where it is bound, "eat", "leave_and_eat", or "stay" as it is.

    Without its music it eats. An introvert leaves, and eats, where more than 20 are. A meat eater goes where
    fewer than 8 vegans are and else leaves; a vegetarian where fewer than 25 eat meat or are vegan; a
    vegan by a coin.
    """
    crowded = (crowd == "introvert") & (meat + vegetarian + vegan > 20)
    by_food = F.when(food == "meat", F.when(vegan < 8, "go").otherwise("leave")).when(food == "vegetarian", F.when(meat + vegan < 25, "go").otherwise("stay")).when((food == "vegan") & coin, "go").otherwise("stay")
    return F.when(~F.array_contains(traits, music), "eat").when(crowded, "leave_and_eat").otherwise(by_food)


def restaurant_decision(food: Column, crowd: Column, served: Column, present: Column, hunger: Column, coin: Column) -> Column:
    """What a guest does on hearing of a restaurant: "go", "leave" or "stay" as it is.

    Where more than 10 are, an introvert goes only at a hunger above 400 and else leaves. Above 200, a guest
    goes where its food is served, a vegetarian by a coin also to a vegan place.
    """
    full = (crowd == "introvert") & (present > 10)
    wants = (hunger > 200) & (((food == "vegetarian") & (served == "vegan") & coin) | (served == food))
    return F.when(full & (hunger > 400), "go").when(full, "leave").when(wants, "go").otherwise("stay")


def category_counts(registry: DataFrame) -> DataFrame:
    """(kind, n) of a registry (id, kind)."""
    return registry.groupBy("kind").agg(F.count("*").alias("n"))


def move(agents: DataFrame, targets: DataFrame, speed: float, arrive: float = 2.0) -> DataFrame:
    """agents (id, x, y) a step nearer to their target (id, tx, ty), and whether it is reached."""
    at = agents.join(targets, "id")
    dist = F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"))
    share = F.when(dist > 0, F.least(F.lit(1.0), F.lit(speed) / dist)).otherwise(0.0)
    moved = at.select("id", (F.col("x") + share * (F.col("tx") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("ty") - F.col("y"))).alias("y"), "tx", "ty")
    return moved.withColumn("arrived", F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")) < arrive)


def travelled(track: DataFrame) -> DataFrame:
    """track (agent, step, dist, has_brain) with the running distance of each agent."""
    return track.withColumn("total", F.sum("dist").over(Window.partitionBy("agent").orderBy("step")))
