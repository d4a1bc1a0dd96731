"""Payment and bank rows of one event: scored candidates, suppression, ambiguity, unique and ordered matches, and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions import texts as T
from ledgerloom.functions.lexicon import EVIDENCE
from ledgerloom.operators import pairs
from ledgerloom.operators.durable import cut
from ledgerloom.operators.grouped import map_groups


def match_side(rows: DataFrame, p: str) -> DataFrame:
    """What the match looks at, worked out once per row and not per pair."""
    said = T.text("merchant", "counterparty", "description")
    return rows.where("booking_date is not null").select(
        "amount", *[F.col(c).alias(f"{p}_{c}") for c in ("raw_id", "source", "booking_date", "direction")],
        F.unix_timestamp(F.col("transaction_time").cast("timestamp")).alias(f"{p}_secs"), F.coalesce("bank_card_suffix", F.lit("")).alias(f"{p}_suffix"), T.bank_families(F.col("payment_method")).alias(f"{p}_families"),
        T.merchant_tokens(said).alias(f"{p}_tokens"), T.refund_words(T.text("merchant", "counterparty", "description", "status")).alias(f"{p}_refund"),
        T.payment_rail(said).alias(f"{p}_rail"), F.col("balance").isNotNull().alias(f"{p}_anchored"), T.is_internal_product(T.text("description", "counterparty")).alias(f"{p}_product"),
    )


def match_candidates(payments: DataFrame, banks: DataFrame) -> DataFrame:
    """(left_raw_id, right_raw_id, phase, confidence, evidence) of payment and bank rows of equal amount at most a day apart.

    Rows meet in cells of an amount and a day, each payment in three; texts are read before, and in a cell kinds of rows are compared before rows are, so that pairs that can't be candidates are not made.
    Out go bank rows of the bank's own products, pairs of different directions unless they are a refund's, bank rows that name
    the other wallet, payments without a card or a common bank name, pairs a day apart without merchant or rail, and pairs without any
    sign of their own. Exact phase: one day, the same card or bank, and the same time, merchant or rail.
    """
    kinds = {end: dict(x.dtypes)["raw_id"] for end, x in (("left_raw_id", payments), ("right_raw_id", banks))}
    found = pairs.made(pairs.celled(match_side(payments, "p"), match_side(banks, "b").where("not b_product")))
    return found.withColumns({end: F.col(end).cast(kind) for end, kind in kinds.items() if kind != "string"})


def scored(both: DataFrame, *more: str) -> DataFrame:
    """match_candidates among pairs of match_side rows, of equal amount and at most a day apart, with more of their columns."""
    both = both.where("b_rail is null or b_rail = p_source")
    same_day = F.col("p_booking_date") == F.col("b_booking_date")
    known = lambda c: F.coalesce(c, F.lit(False))
    pair = known((F.col("amount") > 0) & F.col("p_direction").isin("neutral", "income") & (F.col("b_direction") == "income") & F.col("p_refund") & F.col("b_refund"))
    anchored = known(same_day & (F.col("amount") > 0) & (F.col("b_direction") == "income") & F.col("b_anchored") & F.col("p_refund"))
    suffix, bank = (F.col("p_suffix") != "") & (F.col("p_suffix") == F.col("b_suffix")), known(F.arrays_overlap("p_families", "b_families"))
    secs = F.abs(F.col("p_secs") - F.col("b_secs"))
    both = both.where(((F.col("p_direction") == F.col("b_direction")) | pair | anchored) & ((F.col("p_suffix") != "") | bank))
    both = both.withColumns({
        "same_day": same_day, "pair": pair, "anchored": anchored, "suffix": suffix, "bank": bank, "rail": F.col("b_rail").isNotNull(), "merchant": known(F.arrays_overlap("p_tokens", "b_tokens")),
        "exact_time": F.coalesce(secs <= 5, F.lit(False)), "close_time": F.coalesce((secs > 5) & (secs <= 120), F.lit(False)), "timeless": F.col("b_secs").isNull(),
    })
    both = both.where("(same_day or merchant or rail) and (suffix or bank or exact_time or close_time or merchant)")
    c = F.col
    exact = c("same_day") & (c("suffix") | c("bank")) & (c("exact_time") | c("merchant") | c("rail"))
    said = {
        "amount_exact": F.lit(True), "refund_credit_direction": c("pair"), "anchored_refund_credit": ~c("pair") & c("anchored"), "direction_exact": ~c("pair") & ~c("anchored"), "booking_date_exact": c("same_day"),
        "booking_date_adjacent": ~c("same_day"), "bank_suffix_exact": c("suffix"), "bank_name_exact": c("bank"), "payment_rail_exact": c("rail"), "datetime_exact": c("exact_time"), "datetime_close": c("close_time"),
        "bank_time_unavailable": ~c("exact_time") & ~c("close_time") & c("timeless"), "merchant_semantic_match": c("merchant"), "match_phase_exact": exact, "match_phase_fuzzy": ~exact,
    }
    zero = F.lit(0).cast("decimal(4,2)")
    score = sum((F.when(said[k], F.lit(w).cast("decimal(4,2)")).otherwise(zero) for k, w in EVIDENCE.items()), zero)
    return both.select(
        F.col("p_raw_id").alias("left_raw_id"), F.col("b_raw_id").alias("right_raw_id"), F.when(exact, "exact").otherwise("fuzzy").alias("phase"),
        F.least(score, F.lit("0.99").cast("decimal(4,2)")).cast("decimal(4,2)").alias("confidence"), F.concat_ws(",", *[F.when(said[k], F.lit(k)) for k in EVIDENCE]).alias("evidence"), *more,
    )


def suppress_fuzzy(candidates: DataFrame) -> DataFrame:
    """candidates without the fuzzy ones that share either end with an exact one."""
    exact, fuzzy = candidates.where("phase = 'exact'"), candidates.where("phase = 'fuzzy'")
    for end in ("left_raw_id", "right_raw_id"):
        fuzzy = fuzzy.join(exact.select(end).distinct(), end, "left_anti")
    return exact.unionByName(fuzzy.select(*exact.columns))


def with_degrees(candidates: DataFrame) -> DataFrame:
    """candidates with the number of candidates at each end, and ambiguous where either is above one."""
    left = candidates.groupBy("left_raw_id").agg(F.count("*").alias("left_degree"))
    right = candidates.groupBy("right_raw_id").agg(F.count("*").alias("right_degree"))
    out = candidates.join(left, "left_raw_id").join(right, "right_raw_id")
    return out.withColumn("ambiguous", (F.col("left_degree") > 1) | (F.col("right_degree") > 1))


def unique_matches(candidates: DataFrame) -> DataFrame:
    """Candidates alone at both ends: isolated edges, so one pass confirms them all."""
    return with_degrees(candidates).where("not ambiguous").select(*candidates.columns)


def unlinked(raws: DataFrame, pairs: DataFrame) -> DataFrame:
    """raws that stand in no pair."""
    ends = pairs.select(F.explode(F.array("left_raw_id", "right_raw_id")).alias("raw_id"))
    return raws.join(ends, "raw_id", "left_anti")


def competing(candidates: DataFrame, limit_to: DataFrame) -> DataFrame:
    """(left_raw_id, right_raw_id): candidates that share exactly one end with a pair of limit_to. The first and the last pair of an end tell whether there is another."""
    ends = lambda end, other: limit_to.groupBy(end).agg(F.min(other).alias(f"low_{end}"), F.max(other).alias(f"high_{end}"))
    both = candidates.select("left_raw_id", "right_raw_id").distinct().join(ends("left_raw_id", "right_raw_id"), "left_raw_id", "left").join(ends("right_raw_id", "left_raw_id"), "right_raw_id", "left")
    others = [F.col(f"{x}_{end}") != F.col(other) for end, other in (("left_raw_id", "right_raw_id"), ("right_raw_id", "left_raw_id")) for x in ("low", "high")]
    return both.where(F.greatest(*[F.coalesce(x, F.lit(False)) for x in others])).select("left_raw_id", "right_raw_id")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of edges (a, b): the least node each is connected to, by rounds of least labels with pointer jumping.

    Rounds are checkpointed, so a long chain needs no long plan and a lost executor no earlier round.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")))
    for _ in range(rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("m"))
        top = label.select(F.col("node").alias("m"), F.col("component").alias("top"))
        new = cut(step.join(top, "m", "left").select("node", "was", F.least("m", F.coalesce("top", "m")).alias("component")))
        label = new.select("node", "component")
        if new.where("component < was").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Edges of a key up to which its components are found in one group.
SMALL = 20_000


def _united(edges: list) -> list[tuple]:
    """(node, component) of the edges (a, b) of one key by union-find."""
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for e in edges:
        low, high = sorted((find(e.a), find(e.b)))
        top[high] = low
    return [(x, find(x)) for x in list(top)]


def components_by_key(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """components of edges (key, a, b) where connected nodes share their key, which is not null: keys of at most `small` edges in one step, the others by rounds."""
    edges = cut(edges.select("key", "a", "b"))
    large = cut(edges.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > small).select("key"))
    kind = dict(edges.dtypes)["a"]
    found = map_groups(edges.join(large, "key", "left_anti"), ["key"], [], _united, f"node {kind}, component {kind}")
    return found if large.isEmpty() else found.unionByName(components(edges.join(large, "key", "left_semi")))


def surely_placed(evidence: Column) -> Column:
    """Whether a candidate's evidence has the day, the card or bank, and no time that speaks against it."""
    return F.contains(evidence, F.lit("booking_date_exact")) & T.has_any(evidence, ["bank_suffix_exact", "bank_name_exact"]) & T.has_any(evidence, ["bank_time_unavailable", "datetime_exact", "datetime_close"])


def ordered_matches(candidates: DataFrame, payments: DataFrame, banks: DataFrame) -> DataFrame:
    """(left_raw_id, right_raw_id) of groups of connected candidates whose payments, by time, and bank rows, by place in the statement, pair off one to one.

    A group counts only if every pair so made, up to the shorter side, is a candidate with exact day and card or bank; then all its pairs are returned.
    """
    left, right = F.concat(F.lit("L"), "left_raw_id"), F.concat(F.lit("R"), "right_raw_id")
    candidates = cut(candidates.select("left_raw_id", "right_raw_id", "evidence"))
    amounts = payments.select(F.col("raw_id").alias("left_raw_id"), F.col("amount").alias("key"))  # candidates are of one amount
    nodes = cut(components_by_key(candidates.join(amounts, "left_raw_id").select("key", left.alias("a"), right.alias("b"))))
    side = lambda letter: nodes.where(F.col("node").startswith(letter)).select(F.expr("substring(node, 2)").alias("raw_id"), "component")
    of = Window.partitionBy("component")
    p = side("L").join(payments.select("raw_id", "booking_date", "transaction_time"), "raw_id").select("component", F.col("raw_id").alias("left_raw_id"), F.col("transaction_time").isNotNull().alias("timed"), F.row_number().over(of.orderBy("booking_date", "transaction_time", "raw_id")).alias("nth"))
    b = side("R").join(banks.select("raw_id", "booking_date", "raw_row_number"), "raw_id").select("component", F.col("raw_id").alias("right_raw_id"), F.col("raw_row_number").isNotNull().alias("placed"), F.row_number().over(of.orderBy("booking_date", "raw_row_number", "raw_id")).alias("nth"))
    fit = surely_placed(F.col("evidence"))
    made = p.join(b, ["component", "nth"]).join(candidates.select("left_raw_id", "right_raw_id", fit.alias("fit")), ["left_raw_id", "right_raw_id"], "left")
    good = made.groupBy("component").agg(F.bool_and(F.coalesce("fit", F.lit(False)) & F.col("timed") & F.col("placed")).alias("ok")).where("ok")
    return made.join(good, "component").select("component", "nth", "left_raw_id", "right_raw_id")


def subset_sums(banks: DataFrame, payments: DataFrame) -> DataFrame:
    """(bank_id, payment_ids, solutions, unique): two or three payments of a bank row's account, day and sign that add up to it.

    Both are (row_id, account, day, amount). Payments are first counted by amount: sums are sought among the distinct amounts of an
    account and day, and only amounts that solve one are turned into rows; the last part is found by its amount, so the joins are
    on keys and not over pairs. unique: the bank row has one solution, and each payment stands in one unique solution.
    """
    key = ["account", "day", "sign"]
    sign = F.signum(F.col("amount").cast("double")).alias("sign")
    b = banks.select(F.col("row_id").alias("bank_id"), "account", "day", sign, F.col("amount").alias("total"))
    pays = payments.select("row_id", "account", "day", sign, "amount").where("sign <> 0")
    values = pays.groupBy(*key, "amount").agg(F.count("*").alias("n"))
    v = lambda k: values.select(*key, F.col("amount").alias(k), F.col("n").alias(f"n_{k}"))
    totals = b.select(*key, "total").distinct()
    less = lambda *used: (F.col("total") - sum((F.col(u) for u in used), F.lit(0))).cast(X.MONEY)
    two = totals.join(v("x"), key).withColumn("y", less("x")).where("x <= y").join(v("y"), [*key, "y"]).where("x < y or n_x > 1")
    three = totals.join(v("x"), key).where("abs(x) < abs(total)").join(v("y"), key).where("x <= y").withColumn("z", less("x", "y")).where("y <= z").join(v("z"), [*key, "z"])
    three = three.where("(x < y or n_x > 1) and (y < z or n_y > 1) and (x < z or n_x > 2)")
    row = lambda k: pays.select(*key, F.col("amount").alias(k), F.col("row_id").alias(f"i_{k}"))
    pair = two.join(row("x"), [*key, "x"]).join(row("y"), [*key, "y"]).where("x < y or i_x < i_y").select(*key, "total", F.array("i_x", "i_y").alias("ids"))
    trio = three.join(row("x"), [*key, "x"]).join(row("y"), [*key, "y"]).where("x < y or i_x < i_y").join(row("z"), [*key, "z"]).where("y < z or i_y < i_z").select(*key, "total", F.array("i_x", "i_y", "i_z").alias("ids"))
    found = b.join(pair.unionByName(trio), [*key, "total"]).select("bank_id", F.sort_array("ids").alias("payment_ids"))
    per_bank = found.groupBy("bank_id").agg(F.count("*").alias("solutions"))
    found = found.join(per_bank, "bank_id")
    uses = found.where("solutions = 1").select(F.explode("payment_ids").alias("id")).groupBy("id").agg(F.count("*").alias("uses")).where("uses > 1")
    shared = found.where("solutions = 1").select("bank_id", F.explode("payment_ids").alias("id")).join(uses, "id").select("bank_id").distinct().withColumn("shared", F.lit(True))
    return found.join(shared, "bank_id", "left").select("bank_id", "payment_ids", "solutions", ((F.col("solutions") == 1) & F.col("shared").isNull()).alias("unique"))


def mixed_funding(payments: DataFrame, banks: DataFrame) -> DataFrame:
    """(raw_id, bank_id, bank_amount): the one bank row that best explains the bank's part of a mixed payment.

    payments: raw_id, account, day, amount, merchant; banks: bank_id, account, day, amount (below 0), merchant. Within three days and no
    larger than the payment, of the same merchant or a generic wallet name; ranked by merchant, days, size; a tie for the best is no answer.
    Payments of one account, day, size and merchant have one answer, and bank rows alike in these are counted, so work grows with such kinds
    and not with pairs of rows. Each kind looks at seven days of its account. Without a merchant's own rows all others are a wallet's alone.
    """
    kind = ["account", "d", "a", "m"]
    p = payments.select("raw_id", "account", F.col("day").alias("d"), F.abs("amount").alias("a"), F.col("merchant").alias("m"))
    look = p.select(*kind).distinct().withColumn("day", F.explode(F.array(*[F.date_add("d", k) for k in range(-3, 4)])))
    b = banks.where("amount < 0").groupBy("account", "day", F.abs("amount").alias("bank_amount"), F.col("merchant").alias("m")).agg(F.count("*").alias("n"), F.min("bank_id").alias("bank_id"))
    generic = b.where(F.contains("m", F.lit("支付宝"))).groupBy("account", "day", "bank_amount").agg(F.sum("n").alias("n"), F.min("bank_id").alias("bank_id"))
    near = look.join(b, ["account", "day", "m"]).withColumn("other", F.lit(False)).unionByName(look.join(generic, ["account", "day"]).withColumn("other", F.lit(True)))
    ranked = near.where("bank_amount <= a").groupBy(*kind, "other", F.abs(F.datediff("day", "d")).alias("gap"), (-F.col("bank_amount")).alias("less")).agg(F.sum("n").alias("n"), F.min("bank_id").alias("bank_id"))
    best = ranked.groupBy(*kind).agg(F.min(F.struct("other", "gap", "less", "n", "bank_id")).alias("b")).where("b.n = 1")
    alike = [F.col(f"p.{k}").eqNullSafe(F.col(f"best.{k}")) for k in kind]
    return p.alias("p").join(best.alias("best"), alike).select("p.raw_id", "best.b.bank_id", (-F.col("best.b.less")).cast(X.MONEY).alias("bank_amount"))
