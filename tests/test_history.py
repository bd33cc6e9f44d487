import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskframe.catalog.tables import SPEC
from riskframe.operators import history
from riskframe.operators.history import add_history, cut_hot_keys, entity_state, history_for_unlabelled, merge_state

SCHEMA = (
    "transaction_id long, transaction_dt long, amount decimal(18,2), "
    "card_entity_key string, email_entity_key string, device_entity_key string"
)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if a is None else Decimal(str(a)), *k) for i, t, a, *k in rows], SCHEMA)


def by_id(df):
    return {r["transaction_id"]: r.asDict() for r in df.collect()}


SEVEN = [
    (11, None, 7.25, "p", "x", "u"),
    (12, 500, 40, "p", "x", "u"),
    (13, 500, None, "p", "y", "u"),
    (14, 500, 2.5, "q", "y", "u"),
    (15, 730, 60.25, "p", "x", "w"),
    (16, 731, 1, "q", None, "w"),
    (17, 9000, 5, "p", "x", "w"),
]


def test_rows_without_time_come_first_and_ties_go_by_id(spark):
    rows = by_id(add_history(frame(spark, SEVEN), SPEC))
    counts = {i: (r["prior_card_transaction_count"], r["prior_email_transaction_count"], r["prior_device_transaction_count"]) for i, r in rows.items()}
    assert counts == {11: (0, 0, 0), 12: (1, 1, 1), 13: (2, 0, 2), 14: (0, 1, 3), 15: (3, 2, 0), 16: (1, 0, 1), 17: (4, 3, 2)}
    assert rows[15]["prior_card_amount_sum"] == 47.25 and rows[15]["prior_card_avg_amount"] == 47.25 / 3
    assert rows[17]["prior_email_avg_amount"] == 107.5 / 3 and rows[14]["prior_email_avg_amount"] == 0
    assert [rows[i]["time_since_previous_card_transaction"] for i in (12, 13, 15, 17)] == [None, 0, 230, 8270]


def many(seed=1, n=600):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        hot = pick.random() < 0.4
        amount = None if pick.random() < 0.1 else round(pick.uniform(1, 900), 2)
        key = "hot" if hot else f"k{pick.randrange(40)}"
        rows.append((i, pick.randrange(200), amount, key, "one" if hot else "two", f"d{pick.randrange(3)}"))
    return rows


def brute(rows):
    """Histories by definition, row by row."""
    out = {}
    for row in rows:
        earlier = [r for r in rows if (r[1], r[0]) < (row[1], row[0])]
        entry = {}
        for entity, at in (("card", 3), ("email", 4), ("device", 5)):
            same = [r for r in earlier if r[at] == row[at]]
            amounts = [r[2] for r in same if r[2] is not None]
            total = sum(round(a * 100) for a in amounts) / 100
            divisor = len(same) if entity == "card" else len(amounts)
            entry[f"prior_{entity}_transaction_count"] = len(same)
            entry[f"prior_{entity}_amount_sum"] = total
            entry[f"prior_{entity}_avg_amount"] = total / divisor if divisor else 0.0
            if entity == "card":
                mean = total / len(amounts) if amounts else 0
                spread = sum((a - mean) ** 2 for a in amounts)
                entry["prior_card_amount_stddev"] = (spread / (len(amounts) - 1)) ** 0.5 if len(amounts) > 1 else 0.0
                last = max((r[1] for r in same), default=None)
                entry["time_since_previous_card_transaction"] = None if last is None else float(row[1] - last)
        out[row[0]] = entry
    return out


@pytest.mark.parametrize("rows_per_task", [10**6, 100, 5])
def test_any_chunking_equals_brute_force(spark, rows_per_task):
    rows = many()
    expected = brute(rows)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    got = by_id(add_history(frame(spark, shuffled).repartition(3), SPEC, rows_per_task=rows_per_task))
    assert len(got) == len(rows)
    for i, entry in expected.items():
        for name, value in entry.items():
            assert got[i][name] == (None if value is None else pytest.approx(value, abs=1e-6)), (i, name)


def burst(n=3000):
    """Most of a key in one second, one stray row far before, some far after, and rows without time."""
    rows = [(0, -(10**15), 1.5, "k", "k", "k")]
    rows += [(i, 77, i % 13 + 0.25, "k", "k", "k") for i in range(1, n)]
    rows += [(n + i, 10**17 + i, 2, "k", "other" if i % 2 else "k", "k") for i in range(40)]
    return rows + [(n + 100 + i, None, 3, "k", "k", f"d{i}") for i in range(60)]


def test_no_chunk_holds_more_than_its_rows(spark):
    """However the rows of a key lie in time."""
    df = frame(spark, burst()).repartition(5)
    chunks, units = cut_hot_keys(df, SPEC, ("card", "email", "device"), 50)
    assert units.narrow and chunks.entities == {"card", "email", "device"}
    rows = df.selectExpr("'card' AS entity", "card_entity_key AS key", "transaction_dt AS time", "transaction_id AS id", "CAST(array() AS array<int>) AS path")
    for level in chunks.levels:
        rows = history._into(rows, level, "left")
    sizes = [r["count"] for r in rows.groupBy("path").count().collect()]
    assert sum(sizes) == df.count() and max(sizes) <= 50
    assert len(sizes) <= chunks.before.filter("entity = 'card'").count()


def test_tasks_grow_with_the_rows(spark):
    """More rows than the session's 4 shuffle tasks may take are dealt to more tasks, whether or not a key is hot; the default suits wide rows."""
    rows = [(i, i % 77, 1.5, f"k{i % 301}", f"e{i % 299}", f"d{i % 307}") for i in range(3000)]
    df = frame(spark, rows)
    whole = by_id(add_history(df, SPEC))
    cut = add_history(df, SPEC, rows_per_task=100)
    held = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 20 and max(held) <= 300
    assert by_id(cut.select(*add_history(df, SPEC).columns)) == whole
    assert history.ROWS_PER_TASK <= 500_000


def test_a_low_limit_makes_no_tasks_of_a_few_rows(spark):
    """A shuffle holds a block for each pair of tasks, so their number may not grow with the rows over a limit of a few."""
    rows = [(i, i % 77, 1.5, f"k{i % 3}", f"e{i % 2}", f"d{i % 307}") for i in range(3000)]
    df = frame(spark, rows)
    chunks, units = cut_hot_keys(df, SPEC, ("card", "email", "device"), 5)
    assert units.tasks == history.FEW_TASKS and chunks.entities == {"card", "email", "device"}
    assert history._tasks(6_000_000, 200) == 120
    assert [history._tasks(n, history.ROWS_PER_TASK) for n in (0, 500_001, 10**9)] == [0, 2, 2000]
    whole = add_history(df, SPEC)
    assert by_id(add_history(df, SPEC, rows_per_task=5).select(*whole.columns)) == by_id(whole)


def test_a_burst_has_the_history_of_one_window(spark):
    columns = [c for c in add_history(frame(spark, burst(400)), SPEC).columns]
    whole = by_id(add_history(frame(spark, burst(400)), SPEC).select(columns))
    assert by_id(add_history(frame(spark, burst(400)), SPEC, rows_per_task=20).select(columns)) == whole
    last = max(whole.values(), key=lambda r: r["prior_card_transaction_count"])
    amounts = [r[2] for r in burst(400)][:-61] + [3] * 60
    assert last["prior_card_amount_sum"] == pytest.approx(sum(r[2] for r in burst(400)) - 2)
    assert len(amounts) > 400


def test_amounts_of_many_decimals_and_large_ones_are_not_rounded(spark):
    schema = SCHEMA.replace("decimal(18,2)", "double")
    rows = [(i, i, (0.001234567 if i % 2 else 4.0e10) * (1 + i % 3), "k", "k", "k") for i in range(40)]
    for limit in (10**6, 7):
        got = by_id(add_history(spark.createDataFrame(rows, schema), SPEC, rows_per_task=limit))
        for i in (3, 20, 39):
            before = [r[2] for r in rows[:i]]
            mean = sum(before) / i
            assert got[i]["prior_card_amount_sum"] == pytest.approx(sum(before), rel=1e-15)
            assert got[i]["prior_card_amount_stddev"] == pytest.approx((sum((x - mean) ** 2 for x in before) / (i - 1)) ** 0.5, rel=1e-12)
    small = [(i, i, 0.001234567, "k", "k", "k") for i in range(4)]
    assert by_id(add_history(spark.createDataFrame(small, schema), SPEC))[3]["prior_email_amount_sum"] == 0.003703701


def test_later_rows_change_nothing(spark):
    rows = many(n=200)
    early = [r for r in rows if r[1] < 100]
    whole = by_id(add_history(frame(spark, rows), SPEC))
    part = by_id(add_history(frame(spark, early), SPEC))
    assert all(part[i] == whole[i] for i in part)


def test_unlabelled_rows_see_the_labelled_ones(spark):
    rows = frame(spark, SEVEN)
    past, new = rows.filter("transaction_id < 15").withColumn("label", F.lit(0)), rows.filter("transaction_id >= 15")
    got = by_id(history_for_unlabelled(past, new, SPEC))
    assert sorted(got) == [15, 16, 17]
    assert got[15]["prior_card_amount_sum"] == 47.25


def test_no_join_without_hot_keys(spark):
    plan = add_history(frame(spark, SEVEN), SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_large_equal_amounts_and_rows_without_time(spark):
    """The spread of large amounts does not cancel, and chunks give what one window gives, with NULL times and a NaN amount."""
    rows = [(i, None if i % 7 == 0 else i // 3, 30_000_000.0 + (i % 2) / 100, "k", "k", "k") for i in range(60)]
    rows.append((60, 5, float("nan"), "k", "k", "k"))
    df = spark.createDataFrame(rows, SCHEMA.replace("decimal(18,2)", "double"))
    columns = [c for c in add_history(df, SPEC).columns if c != "amount"]
    whole = {r.transaction_id: r for r in add_history(df, SPEC).select(columns).collect()}
    assert whole == {r.transaction_id: r for r in add_history(df, SPEC, rows_per_task=8).select(columns).collect()}
    last = max(whole.values(), key=lambda r: r.prior_card_transaction_count)
    assert abs(last.prior_card_amount_stddev - 0.005) < 0.0002


@pytest.mark.parametrize("rows_per_task", [10**6, 9])
def test_history_goes_on_from_stored_states(spark, rows_per_task):
    rows = many(n=300)
    whole = by_id(add_history(frame(spark, rows), SPEC))
    parts = [frame(spark, [r for r in rows if low <= r[1] < high]) for low, high in ((0, 60), (60, 61), (61, 130), (130, 999))]
    state = entity_state(parts[0], SPEC)
    for part in parts[1:3]:
        state = merge_state(state, entity_state(part, SPEC))
    got = by_id(add_history(parts[3], SPEC, rows_per_task=rows_per_task, state=state))
    assert len(got) == parts[3].count() > 0
    for i, row in got.items():
        assert {k: pytest.approx(v, rel=1e-12, abs=1e-9) if isinstance(v, float) else v for k, v in whole[i].items()} == row
    expected = {(r.entity, r.key): r for r in entity_state(frame(spark, [r for r in rows if r[1] < 130]), SPEC).collect()}
    for r in state.collect():
        e = expected.pop((r.entity, r.key))
        assert (r.n, r.known, r.total, r.latest) == (e.n, e.known, e.total, e.latest)
        assert r.squares == pytest.approx(e.squares)
    assert not expected


def test_rows_before_the_state_are_refused(spark):
    state = entity_state(frame(spark, SEVEN), SPEC)
    for late in ([(20, 9000, 1, "p", "x", "u")], [(20, None, 1, "p", "x", "u")]):
        with pytest.raises(ValueError, match="do not come after the state"):
            add_history(frame(spark, late), SPEC, state=state)
    empty = frame(spark, SEVEN).limit(0)
    assert add_history(empty, SPEC, state=state).count() == 0
    assert by_id(add_history(frame(spark, SEVEN), SPEC, state=entity_state(empty, SPEC))) == by_id(add_history(frame(spark, SEVEN), SPEC))
