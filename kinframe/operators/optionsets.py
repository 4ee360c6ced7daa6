"""Search for the best sets of options of workloads, by branch and bound in rounds of DataFrames.

A workload is one row of ``problems``: its matrix of cost and memory by option and
query, its limits, and multipliers: for a multiplier x, cells are priced cost + x mem, and the
sum of the least prices of a set less x times the budget is a lower bound of what the set
can cost (the Lagrangian dual; x = 0 where there is no budget). Cells not measured cost
``penalty``, so that an assignment costs less than half of it and anything with such a cell more.

Sets grow by one option a round, in ascending order of options, so each set comes up
once. A set is given up where a lower bound of everything that can grow from it is above
the cost of an assignment already known (``known``, found greedily): either with the least
prices of all options still allowed, or with the largest savings of as many of them as
there is room for (savings shrink as a set grows). Nothing else is given up, so the
result is exact; no table of all subsets is made.

For each set that is left a budget asks for a choice with one option a query. Where each
query's cheapest does not fit, queries are taken in blocks, whose choices are few by
the block's size, then blocks in pairs: log2(blocks) rounds. A choice is given up where
another is no worse in cost and memory, or where its bound at the set's own multipliers
is above what is known.

Rows of a workload are dealt over ``SALTS`` tasks, and choices by set, block and range of
memory; a matrix is one row, so options times queries of one workload must fit a task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

SALTS = 16
#: Choices of a block of queries at most, before any is given up.
BLOCK_CHOICES = 1024
#: Ranges of memory by which the choices of a block are dealt.
RANGES = 64
#: Bounds are sums of doubles in another order than the costs they are compared with.
SLACK = "1e-9D * (1 + abs({0}))"


def priced(x: str, options: str, cost: str = "cost", mem: str = "mem", queries: str = "sequence(0, nq - 1)") -> str:
    """SQL: struct(v, m, c) with the sums over queries of price, memory and cost of the cheapest option at multiplier ``x``."""
    best = f"array_min(transform({options}, f -> struct({cost}[f][q] + {x} * {mem}[f][q] AS v, {mem}[f][q] AS m, {cost}[f][q] AS c)))"
    return f"aggregate(transform({queries}, q -> {best}), named_struct('v', 0D, 'm', 0D, 'c', 0D), (a, b) -> named_struct('v', a.v + b.v, 'm', a.m + b.m, 'c', a.c + b.c))"


def bisected(options: str, start: str, rounds: int = 48) -> str:
    """SQL: struct(low, high) of multipliers between which the cheapest choices of ``options`` begin to fit ``max_mem``; high fits unless nothing does."""
    fits = priced("(a.low + a.high) / 2", options) + ".m <= max_mem"
    step = f"IF({fits}, named_struct('low', a.low, 'high', (a.low + a.high) / 2), named_struct('low', (a.low + a.high) / 2, 'high', a.high))"
    return f"aggregate(sequence(1, {rounds}), named_struct('low', 0D, 'high', {start}), (a, k) -> {step})"


def problems(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """A row a workload: n (options allowed), max_mem, nq, nf, queries, options, cost and mem as [option][query], penalty, multipliers xs, flat, suffix, known.

    ``cells(workload, query, option, cost, mem)`` has one row a cell; ``limits`` as in ``assign``.
    flat[f]: prices of option f, one stretch of nq a multiplier, then its memory;
    suffix[f]: the least of these over options from f on.
    """
    number = lambda by: (F.dense_rank().over(Window.partitionBy("workload").orderBy(by)) - 1).cast("int")
    placed = cells.select("*", number("query").alias("q"), number("option").alias("f")).withColumn("nq", F.max("q").over(Window.partitionBy("workload")) + 1)
    by_option = placed.groupBy("workload", "f").agg(F.first("option").alias("option"), F.max("nq").alias("nq"), F.map_from_entries(F.collect_list(F.struct("q", F.struct("cost", "mem")))).alias("m"), F.collect_list(F.struct("q", "query")).alias("named"))
    rows = by_option.groupBy("workload").agg(F.sort_array(F.collect_list(F.struct("f", "option"))).alias("options"), F.array_sort(F.collect_list(F.struct("f", "m")), lambda a, b: a["f"] - b["f"]).alias("ms"), F.max("nq").alias("nq"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("named")))).alias("queries"))
    limit = limits.groupBy("workload").agg(F.min("max_options").alias("max_options"), F.min(F.col("max_mem").cast("double")).alias("max_mem"))
    out = rows.join(limit, "workload").withColumn("nf", F.size("options"))
    out = out.withColumn("n", F.least(F.coalesce("max_options", "nf"), "nf").cast("int")).where("n >= 1").drop("max_options")
    most = "aggregate(sequence(0, nq - 1), 0D, (a, q) -> a + aggregate(ms, 0D, (b, x) -> greatest(b, abs(coalesce(try_element_at(x.m, q).cost, 0D)))))"
    out = out.withColumn("penalty", F.expr(f"1D + 2 * {most}"))
    grid = "transform(ms, x -> transform(sequence(0, nq - 1), q -> {}))"
    out = out.withColumn("cost", F.expr(grid.format("coalesce(try_element_at(x.m, q).cost, penalty)"))).withColumn("mem", F.expr(grid.format("CAST(coalesce(try_element_at(x.m, q).mem, 0) AS DOUBLE)"))).drop("ms")
    # a budget that can never bind is none
    top = "aggregate(sequence(0, nq - 1), 0D, (a, q) -> a + array_max(transform({0}, x -> x[q])))"
    spread = "aggregate(sequence(0, nq - 1), 0D, (a, q) -> a + array_max(transform({0}, x -> x[q])) - array_min(transform({0}, x -> x[q])))"
    out = out.withColumn("max_mem", F.expr(f"least(coalesce(max_mem, {top.format('mem')}), greatest({top.format('mem')}, 0D))"))
    seen = "transform(cost, x -> transform(x, c -> IF(c >= penalty, 0D, c)))"
    out = out.withColumn("slope", F.expr(f"IF(max_mem >= {top.format('mem')}, 0D, greatest({spread.format(seen)}, 1e-9D) / greatest({spread.format('mem')}, 1e-9D))"))
    every = "sequence(0, nf - 1)"
    out = out.withColumn("at", F.expr(f"IF(slope = 0, 0D, {bisected(every, 'slope * 1024')}.high)"))
    out = out.withColumn("xs", F.expr("IF(slope = 0, array(0D), array_distinct(array(0D, at / 2, at, at * 2, slope / 8, slope, slope * 8)))")).drop("slope", "at")
    out = out.withColumn("flat", F.expr("transform(sequence(0, nf - 1), f -> concat(flatten(transform(xs, x -> transform(sequence(0, nq - 1), q -> cost[f][q] + x * mem[f][q]))), mem[f]))"))
    none = "array_repeat(1.0e300D, nq * (size(xs) + 1))"
    out = out.withColumn("suffix", F.expr(f"aggregate(reverse(sequence(0, nf - 1)), array({none}), (a, f) -> concat(array(zip_with(flat[f], a[0], (x, y) -> least(x, y))), a))"))
    # known: per multiplier the set that n steps of greatest saving give, priced at that multiplier, where it fits
    first = "named_struct('least', array_repeat(penalty, nq), 'set', CAST(array() AS array<int>))"
    tried = "array_min(transform(sequence(0, nf - 1), f -> struct(aggregate(zip_with(a.least, sequence(0, nq - 1), (p, q) -> least(p, cost[f][q] + x * mem[f][q])), 0D, (b, p) -> b + p) AS v, f AS f))).f"
    step = f"transform(array({tried}), g -> named_struct('least', zip_with(a.least, sequence(0, nq - 1), (p, q) -> least(p, cost[g][q] + x * mem[g][q])), 'set', array_distinct(concat(a.set, array(g)))))[0]"
    greedy = f"aggregate(sequence(1, n), {first}, (a, k) -> {step}).set"
    found = f"transform(xs, x -> transform(array({greedy}), s -> {priced('x', 's')})[0])"
    return out.withColumn("known", F.expr(f"least(penalty, array_min(transform({found}, r -> IF(r.m <= max_mem, r.c, penalty))))"))


#: What a row of a set needs of its workload's row.
MATRIX = ("n", "max_mem", "nq", "nf", "cost", "mem", "penalty", "xs", "flat", "suffix", "known")


def _sums(array: str) -> str:
    """SQL: sums of the stretches of an array like flat[f]: one a multiplier, then memory."""
    return f"transform(sequence(0, size(xs)), l -> aggregate(slice({array}, l * nq + 1, nq), 0D, (a, x) -> a + x))"


def _bound(sums: str) -> str:
    return f"array_max(transform(sequence(0, size(xs) - 1), l -> {sums}[l] - xs[l] * max_mem))"


def grown(nodes: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` options from those of one fewer, joined to their workload's row; those of workloads with fewer allowed pass."""
    open_ = nodes.where(f"n >= {size}")
    last = "coalesce(try_element_at(chosen, -1), -1)"
    next_ = f"IF({last} + 1 <= nf - 1 - (n - {size}), sequence({last} + 1, nf - 1 - (n - {size})), CAST(array() AS array<int>))"
    open_ = open_.withColumn("kids", F.expr(f"transform({next_}, f -> named_struct('f', f, 'least', zip_with(least, flat[f], (x, y) -> least(x, y))))"))
    open_ = open_.withColumn("kids", F.expr(f"transform(kids, k -> named_struct('f', k.f, 'least', k.least, 'sums', {_sums('k.least')}))")).withColumn("own", F.expr(_sums("least")))
    below = _sums("zip_with(k.least, suffix[k.f + 1], (x, y) -> least(x, y))")
    # the options that can still come behind: savings over this set bound savings over any larger one
    saving = f"aggregate(slice(sort_array(transform(filter(every, e -> e.f > k.f), e -> greatest(0D, own[l] - e.sums[l])), false), 1, n - {size}), 0D, (a, x) -> a + x)"
    by_savings = f"transform(sequence(0, size(xs) - 1), l -> k.sums[l] - IF(n = {size}, 0D, {saving}))"
    all_later = "transform(IF({0} + 1 <= nf - 1, sequence({0} + 1, nf - 1), CAST(array() AS array<int>)), f -> named_struct('f', f, 'sums', {1}))".format(last, _sums("zip_with(least, flat[f], (x, y) -> least(x, y))"))
    open_ = open_.withColumn("every", F.expr(f"IF(n = {size}, NULL, {all_later})"))
    low = f"transform(array(IF(n = {size}, k.sums, {below})), s -> s[size(xs)] <= max_mem AND s[0] < penalty / 2 AND greatest({_bound('s')}, {_bound(by_savings)}) <= known + {SLACK.format('known')})[0]"
    kept = open_.withColumn("kid", F.explode(F.expr(f"filter(kids, k -> {low})")))
    return kept.withColumn("chosen", F.expr("concat(chosen, array(kid.f))")).withColumn("least", F.col("kid.least")).drop("kids", "kid", "own", "every")


def best_sets(rows: DataFrame, most: int) -> DataFrame:
    """(workload, chosen): sets of exactly n options that can hold a cheapest assignment, from ``problems`` rows; ``most``: the greatest n."""
    start = "concat(array_repeat(penalty, nq * size(xs)), array_repeat(1.0e300D, nq))"
    nodes = rows.select("workload", *MATRIX, F.expr("CAST(array() AS array<int>)").alias("chosen"), F.expr(start).alias("least"))
    done = None
    dealt = rows.select("workload", *MATRIX, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    for size in range(1, most + 1):
        nodes = grown(nodes, size)
        whole = nodes.where(f"n = {size}").select("workload", "chosen")
        done = whole if done is None else done.unionByName(whole)
        if size < most:
            left = written(nodes.where(f"n > {size}").select("workload", "chosen", "least"), "sets")
            nodes = left.withColumn("_salt", F.pmod(F.xxhash64("chosen"), F.lit(SALTS)).cast("int")).join(dealt, ["workload", "_salt"]).drop("_salt")
    return done


def measured(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """``sets(workload, chosen)`` with what each costs without a budget, a cost that fits (or the penalty), a lower bound and the multipliers between which it fits; only sets that may be cheapest."""
    dealt = rows.select("workload", "n", "max_mem", "nq", "cost", "mem", "penalty", "known", "xs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    met = sets.withColumn("_salt", F.pmod(F.xxhash64("chosen"), F.lit(SALTS)).cast("int")).join(dealt, ["workload", "_salt"])
    met = met.withColumn("free", F.expr(priced("0D", "chosen"))).withColumn("direct", F.expr("free.m <= max_mem"))
    met = met.withColumn("between", F.expr(f"IF(direct, NULL, {bisected('chosen', 'array_max(xs) * 1024')})"))
    met = met.withColumn("low", F.expr(priced("between.low", "chosen"))).withColumn("high", F.expr(priced("between.high", "chosen")))
    met = met.withColumn("bound", F.expr("IF(direct, free.c, greatest(low.v - between.low * max_mem, high.v - between.high * max_mem))")).withColumn("fitting", F.expr("IF(direct, free.c, IF(high.m <= max_mem, high.c, penalty))"))
    out = written(met.select("workload", "chosen", "direct", "bound", "fitting", "known", "penalty", "between"), "measured")
    best = out.groupBy("workload").agg(F.min(F.least("fitting", "known")).alias("ub"))
    return out.join(best, "workload").where(f"bound <= ub + {SLACK.format('ub')} AND bound < penalty / 2").select("workload", "chosen", "direct", "between", "ub")


def chosen_picks(direct: DataFrame, rows: DataFrame) -> DataFrame:
    """(workload, c, mem, picks) of sets whose cheapest choices fit: each query's option by cost, memory and place."""
    met = direct.select("workload", "chosen").join(rows.select("workload", "nq", F.col("cost").alias("costs"), F.col("mem").alias("mems")), "workload")
    met = met.withColumn("p", F.expr("transform(sequence(0, nq - 1), q -> array_min(transform(chosen, f -> struct(costs[f][q] AS c, mems[f][q] AS m, f AS f))))"))
    return met.select("workload", F.expr("aggregate(p, 0D, (a, x) -> a + x.c)").alias("c"), F.expr("aggregate(p, 0D, (a, x) -> a + x.m)").alias("mem"), F.expr("transform(p, x -> x.f)").alias("picks"))


def _skyline(states: str) -> str:
    """SQL: of states struct(mem, c, picks), in order, those that cost less than all before them."""
    step = "IF(size(a) = 0 OR s.c < try_element_at(a, -1).c, concat(a, array(s)), a)"
    return f"aggregate(array_sort({states}), CAST(array() AS array<struct<mem:double,c:double,picks:array<int>>>), (a, s) -> {step})"


#: Lower bound of a state of some queries: what the others cost at least, at each of the set's multipliers.
STATE_BOUND = "c + array_max(transform(sequence(0, size(lams) - 1), l -> total[l] - inside[l] - lams[l] * (max_mem - mem)))"


def block_states(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """States of blocks of queries of every set: (workload, chosen, block, blocks, mem, c, picks, inside, lams, total, max_mem, ub)."""
    met = sets.join(rows.select("workload", "nq", "max_mem", F.col("cost").alias("costs"), F.col("mem").alias("mems")), "workload")
    span = f"IF(size(chosen) = 1, nq, greatest(1, CAST(floor(ln({BLOCK_CHOICES}) / ln(size(chosen))) AS INT)))"
    met = met.withColumn("span", F.expr(span)).withColumn("lams", F.expr("array_distinct(array(0D, between.low, between.high, between.high * 4))"))
    total = lambda queries: f"transform(lams, x -> {priced('x', 'chosen', 'costs', 'mems', queries)}.v)"
    met = met.withColumn("total", F.expr(total("sequence(0, nq - 1)"))).withColumn("blocks", F.expr("CAST(ceil(nq / span) AS INT)"))
    met = met.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    here = "sequence(block * span, least(nq, (block + 1) * span) - 1)"
    one = "flatten(transform(a, s -> transform(chosen, f -> named_struct('mem', s.mem + mems[f][q], 'c', s.c + costs[f][q], 'picks', concat(s.picks, array(f))))))"
    start = "array(named_struct('mem', 0D, 'c', 0D, 'picks', CAST(array() AS array<int>)))"
    met = met.withColumn("inside", F.expr(total(here))).withColumn("states", F.expr(f"aggregate({here}, {start}, (a, q) -> {_skyline(one)})"))
    flat = met.select("workload", "chosen", "block", "blocks", "inside", "lams", "total", "max_mem", "ub", F.inline("states"))
    return flat.where(f"mem <= max_mem AND {STATE_BOUND} <= ub + {SLACK.format('ub')}")


def paired(states: DataFrame) -> DataFrame:
    """States of pairs of neighbouring blocks, without those that another of the pair beats."""
    key = ["workload", "chosen", "pair"]
    left = states.where("block % 2 = 0").withColumn("pair", F.expr("block div 2")).drop("block")
    right = states.where("block % 2 = 1").select("workload", "chosen", F.expr("block div 2").alias("pair"), F.col("mem").alias("mem2"), F.col("c").alias("c2"), F.col("picks").alias("picks2"), F.col("inside").alias("inside2"))
    lone = F.expr("pair * 2 + 1 >= blocks")
    both = left.where(~lone).join(right, key).withColumn("mem", F.expr("mem + mem2")).withColumn("c", F.expr("c + c2")).withColumn("picks", F.concat("picks", "picks2")).withColumn("inside", F.expr("zip_with(inside, inside2, (x, y) -> x + y)")).drop("mem2", "c2", "picks2", "inside2")
    both = both.where(f"mem <= max_mem AND {STATE_BOUND} <= ub + {SLACK.format('ub')}")
    ranged = written(both.unionByName(left.where(lone).select(*both.columns)).withColumn("zone", F.expr(f"CAST(least({RANGES}, floor(mem * {RANGES} / greatest(max_mem, 1D))) AS INT)")), "pairs")
    before = Window.partitionBy(*key).orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    lows = ranged.groupBy(*key, "zone").agg(F.min("c").alias("low")).select(*key, "zone", F.min("low").over(before).alias("low"))
    inner = Window.partitionBy(*key, "zone").orderBy("mem", "c", "picks").rowsBetween(Window.unboundedPreceding, -1)
    kept = ranged.withColumn("near", F.min("c").over(inner)).where("near IS NULL OR c < near").join(lows, [*key, "zone"]).where("low IS NULL OR c < low")
    return kept.withColumn("block", F.col("pair").cast("int")).withColumn("blocks", F.expr("CAST(ceil(blocks / 2) AS INT)")).drop("pair", "zone", "near", "low")


def solved(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """(workload, picks): the cheapest assignment within the limits, picks: array of struct(query, option, cost, mem) in order of queries.

    Of equal costs the one with least memory, then the one whose options, in order of queries, are
    lowest. Workloads without an assignment have no row. Tables are written on the way, so this runs when called.
    """
    rows = written(problems(cells, limits), "problems")
    most, budgets = rows.agg(F.max("n"), F.max(F.size("xs"))).first()
    if most is None:
        return rows.select("workload", _named()).where("false")
    sets = measured(best_sets(rows, most), rows)
    found = chosen_picks(sets.where("direct"), rows)
    if budgets > 1:
        states = written(block_states(sets.where("NOT direct"), rows), "states")
        blocks = states.agg(F.max("blocks")).first()[0] or 0
        for _ in range(math.ceil(math.log2(blocks)) if blocks > 1 else 0):
            states = written(paired(states), "states")
        found = found.unionByName(states.select("workload", "c", "mem", "picks"))
    best = found.groupBy("workload").agg(F.min(F.struct("c", "mem", "picks")).alias("b"))
    return best.join(rows, "workload").where("b.c < penalty / 2").withColumn("picked", F.col("b.picks")).select("workload", _named())


def _named():
    return F.expr("transform(picked, (f, q) -> struct(queries[q].query AS query, options[f].option AS option, cost[f][q] AS cost, CAST(mem[f][q] AS BIGINT) AS mem)) AS picks")
