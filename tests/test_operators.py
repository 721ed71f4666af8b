import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import basket, cooccur, graph, joins, ordering, relational, tagging
from sparkloom.plans import catalog

# The inputs of the golden fixtures (FIXTURES.md); the results that tests below expect of them are fixed too.
SERIES = [r.split(",") for r in "x,2,9 y,2,5 x,1,3 y,1,7 y,3,1 x,3,6 z,1,4 z,2,8 z,3,7 z,4,0 p,1,10 p,3,60 p,4,40 p,6,20".split()]
USERS = [("u1", "UT"), ("u2", "GA"), ("u3", "GA"), ("u4", "CA"), ("u5", "GA")]
SALES = [("t1", "p3", "u1"), ("t2", "p1", "u2"), ("t3", "p1", "u1"), ("t4", "p2", "u2"), ("t5", "p4", "u4"), ("t6", "p1", "u1"), ("t7", "p4", "u1"), ("t8", "p4", "u5")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts_and_averages(spark):
    people = spark.createDataFrame([("Michael", None), ("Andy", 30), ("Justin", 19)], "name string, age long")
    assert rows(relational.group_count(people, "age")) == sorted([(19, 1), (None, 1), (30, 1)], key=str)
    assert rows(people.select("name", F.col("age") + 1)) == [("Andy", 31), ("Justin", 20), ("Michael", None)]
    pay = spark.createDataFrame([("Michael", 3000), ("Andy", 4500), ("Justin", 3500), ("Berta", 4000), ("x", None)], "name string, salary long")
    assert pay.agg(relational.average("salary")).first()[0] == 3750.0
    assert math.isnan(pay.limit(0).agg(relational.average("salary")).first()[0])
    relational.register_average(spark)
    relational.view(pay, "pay")
    assert spark.sql("SELECT myAverage(salary) FROM pay").first()[0] == 3750.0
    relational.view(pay, "pay_everywhere", everywhere=True)
    assert spark.newSession().sql("SELECT count(*) FROM global_temp.pay_everywhere").first()[0] == 5
    with pytest.raises(Exception, match="TEMP_TABLE_OR_VIEW_ALREADY_EXISTS"):
        relational.view(pay, "pay_everywhere", everywhere=True)
    assert relational.total_length(spark.createDataFrame([("ab",), ("",), ("é",)], "c string"), "c").first()[0] == 3
    assert relational.frame(spark, [("a", "b")], "name age").dtypes == [("name", "string"), ("age", "string")]


def test_set_functions(spark):
    r = spark.createDataFrame([([100, 200, 500], [100, 300, 500, 700])], "a array<int>, b array<int>")
    assert r.select(relational.sorted_intersection("a", "b")).first()[0] == [100, 500]
    assert r.select(relational.without_items("a", "b")).first()[0] == [200]


def test_log_key_and_shapes(spark):
    lines = spark.createDataFrame([("dpc_js\x011\x012\x013\x014\x01k",), ("dpc_visit\x01v",), ("other\x01x",)], "value string")
    from sparkloom.functions.text import jsplit

    got = lines.select(relational.log_key(jsplit("value", "\x01"), {"dpc_js": 5, "dpc_visit": 1}).alias("k"))
    assert rows(got) == [("",), ("k",), ("v",)]
    assert relational.well_formed(spark.createDataFrame([("a,1",), ("a",), ("a,b,c",)], "v string"), "v", ",", 2).count() == 1


def test_secondary_sort(spark):
    df = spark.createDataFrame([(n, int(t), int(v)) for n, t, v in SERIES], "name string, time int, value int")
    got = {r["name"]: [tuple(x) for x in r["series"]] for r in ordering.secondary_sort(df, "name", "time", "value").collect()}
    assert got == {"x": [(1, 3), (2, 9), (3, 6)], "y": [(1, 7), (2, 5), (3, 1)], "z": [(1, 4), (2, 8), (3, 7), (4, 0)], "p": [(1, 10), (3, 60), (4, 40), (6, 20)]}
    twice = df.unionByName(df)
    assert [tuple(x) for x in ordering.secondary_sort(twice, "name", "time", "value").filter("name = 'x'").first()["series"]] == [(1, 6), (2, 18), (3, 12)]
    assert len(ordering.secondary_sort(twice, "name", "time", "value", "keep").filter("name = 'x'").first()["series"]) == 6


def test_partitions(spark):
    df = spark.createDataFrame([(i, 10 + i) for i in range(9)], "k int, v int")
    parts = [[tuple(r) for r in p] for p in ordering.modulo_partitions(df, "k", 3).rdd.glom().collect()]
    assert parts == [[(0, 10), (3, 13), (6, 16)], [(1, 11), (4, 14), (7, 17)], [(2, 12), (5, 15), (8, 18)]]
    for p in ordering.partition_sort(df.withColumn("g", F.col("k") % 2), "g", "v", 3).select("g", "v").rdd.glom().collect():
        assert [tuple(r) for r in p] == sorted((tuple(r) for r in p), reverse=True)


def test_concat_and_top(spark):
    temps = spark.createDataFrame([("201201", 5), ("201201", 35), ("201212", 10)], "ym string, t int")
    assert rows(ordering.ordered_concat(temps, "ym", ["t"], F.col("t").cast("string"), ",", desc=True)) == [("201201", "35,5,"), ("201212", "10,")]
    cats = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1), ("d", 7)], "name string, w int")
    assert [tuple(r) for r in ordering.top_n(cats, "name", "w", 2).collect()] == [("d", 7), ("b", 3)]
    assert [tuple(r) for r in ordering.top_n(cats, "name", "w", 3, ties="keep").collect()] == [("d", 7), ("a", 3), ("b", 3)]
    assert [tuple(r) for r in ordering.top_n(cats, "name", "w", 2, desc=False).collect()] == [("b", 3), ("d", 7)]
    assert ordering.top_n_two_phase(cats.unionByName(cats), "name", "w", 1).first()["w"] == 14


def test_outer_join(spark):
    users = spark.createDataFrame(USERS, "user string, location string")
    sales = spark.createDataFrame([(p, u) for _, p, u in SALES], "product string, user string")
    found = joins.left_outer_enrich(sales, users, "user", "location")
    got = {r["product"]: (r["values"], r["n"]) for r in relational.distinct_per_key(found, "product", "location").collect()}
    assert got == {"p1": (["GA", "UT"], 2), "p2": (["GA"], 1), "p3": (["UT"], 1), "p4": (["CA", "GA", "UT"], 3)}
    back = {r["location"]: (r["values"], r["n"]) for r in relational.distinct_per_key(found, "location", "product").collect()}
    assert back == {"CA": (["p4"], 1), "GA": (["p1", "p2", "p4"], 3), "UT": (["p1", "p3", "p4"], 3)}
    assert joins.left_outer_enrich(spark.createDataFrame([("p9", "nobody")], "product string, user string"), users, "user", "location", "undefined").first()["location"] == "undefined"


def test_baskets(spark):
    assert basket.power_set(["c", "a", "b"]) == [[], ["a"], ["b"], ["c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"]]
    df = spark.createDataFrame([(i, x) for i, b in enumerate(["abc", "ab", "bc", "abc"]) for x in b], "o int, i string")
    assert rows(basket.itemset_counts(df, "o", "i", 2)) == [(["a", "b"], 3), (["a", "c"], 2), (["b", "c"], 3)]
    rules = {("".join(r["antecedent"]), r["consequent"]): r["confidence"] for r in basket.association_rules(df, "o", "i").collect()}
    assert rules == pytest.approx({("a", "b"): 1, ("b", "a"): 3 / 4, ("a", "c"): 2 / 3, ("c", "a"): 2 / 3, ("b", "c"): 3 / 4, ("c", "b"): 1, ("ab", "c"): 2 / 3, ("ac", "b"): 1, ("bc", "a"): 2 / 3})
    sizes = dict(rows(basket.itemsets_up_to(df, "o", "i", 2).groupBy(F.size("items")).count()))
    assert sizes == {1: 3, 2: 3}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcdef", min_size=1, max_size=2), max_size=6), st.integers(0, 4))
def test_power_set_size(items, most):
    k = len(set(items))
    assert len(basket.power_set(items, most)) == sum(math.comb(k, n) for n in range(min(k, most) + 1))


def test_common_friends(spark):
    lists = "100:200 300 400 500 600;200:100 300 400;300:100 200 400 500;400:100 200 300;500:100 300;600:100"
    df = spark.createDataFrame([(int(p), [int(f) for f in fs.split()]) for p, fs in (x.split(":") for x in lists.split(";"))], "person long, friends array<long>")
    got = {(r["a"], r["b"]): r["common"] for r in graph.common_friends(df).collect()}
    assert got == {(100, 200): [300, 400], (100, 300): [200, 400, 500], (100, 400): [200, 300], (100, 500): [300], (100, 600): [], (200, 300): [100, 400], (200, 400): [100, 300], (300, 400): [100, 200], (300, 500): [100]}
    assert {(r["a"], r["b"]): r["common"] for r in graph.common_friends(df, single_is_empty=False).collect()} == got


@pytest.mark.parametrize(("kind", "single"), [("long", True), ("long", False), ("string", True), ("string", False)])
def test_common_friends_in_cells(spark, monkeypatch, kind, single):
    """Random lists, some of them one-sided, of one friend, of oneself or of nobody, over many small cells."""
    monkeypatch.setattr(graph, "CELL_ENTRIES", 150)
    draw = random.Random(5)
    lists = {p: sorted(draw.sample(range(-3, 40), draw.choice([0, 1, 1, 6, 14]))) for p in range(-2, 38)}
    for p, fs in list(lists.items()):
        for f in fs[::2]:
            if f in lists and p not in lists[f]:
                lists[f].append(p)
    as_kind = int if kind == "long" else str
    df = spark.createDataFrame([(as_kind(p), [as_kind(f) for f in fs]) for p, fs in lists.items()], f"person {kind}, friends array<{kind}>")
    given = {p: set() if single and len(fs) == 1 else set(map(as_kind, fs)) for p, fs in lists.items()}
    expected = {}
    for p, fs in lists.items():
        for f in fs:
            both = p in lists.get(f, ()) and p != f
            expected[tuple(sorted((as_kind(p), as_kind(f))))] = sorted(given[p] & given[f] if both else given[p])
    got = [(r["a"], r["b"], r["common"]) for r in graph.common_friends(df, single).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in expected.items())


def test_common_friends_moves_lists_not_pairs(spark):
    """A join of pairs and list entries makes a row of each friend that each pair walks."""
    plan = graph.common_friends(spark.createDataFrame([(1, [2]), (2, [1])], "person long, friends array<long>"))._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert "explode" not in plan


@pytest.mark.parametrize("texts", [[str(i * 37 % 9_000_000) for i in range(5000)], [""], ["", "\0", "\0\0", "a", "a\0"], ["é", "日本", "zz", "🎉"], ["a", "b" * 100_000, "c"] + [f"d{i}" for i in range(500)]])
def test_packed_lists_come_back(texts):
    for kind in (pa.string(), pa.large_string()):
        ids = pa.array(["before", *sorted(texts), "after"], kind).slice(1, len(texts))
        assert graph._unpack(graph._pack(ids), kind).equals(ids)


def test_packed_lists_are_small():
    """A list crosses the shuffle once for each block it touches; as text it takes about what its numbers take."""
    draw = random.Random(2)
    ids = draw.sample(range(1_000_000, 1_015_000), 1500)
    numbers, texts = pa.array(sorted(ids)), pa.array(sorted(map(str, ids)))
    assert graph._unpack(graph._pack(numbers), pa.int64()).equals(numbers)
    assert len(graph._pack(numbers)) < len(ids)
    assert len(graph._pack(texts)) < 1.5 * len(ids)


def shuffled(spark, act, what="shuffleWriteRecords"):
    """What ``act`` returns, and the rows or bytes that it wrote to shuffles."""
    def stages():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {(x := found.apply(i)).stageId(): getattr(x, what)() for i in range(found.size())}

    before = max(stages(), default=-1)
    return act(), sum(n for k, n in stages().items() if k > before)


@pytest.mark.parametrize(("kind", "single"), [("long", True), ("long", False), ("string", True), ("string", False)])
def test_common_friends_of_groups(spark, monkeypatch, kind, single):
    """Random groups, some of one member, of none, with nulls or copies, over many small cells, as their lists."""
    monkeypatch.setattr(graph, "CELL_ENTRIES", 150)
    draw, as_kind = random.Random(3), int if kind == "long" else str
    groups = [[as_kind(x) for x in draw.choices(range(-3, 40), k=draw.choice([0, 1, 2, 2, 3, 5]))] + draw.choice([[], [None]]) for _ in range(60)]
    friends = {}
    for g in groups:
        for p in set(g) - {None}:
            friends.setdefault(p, set()).update(set(g) - {None, p})
    given = {p: set() if single and len(fs) == 1 else fs for p, fs in friends.items()}
    expected = sorted((a, b, sorted(given[a] & given[b])) for a in friends for b in friends[a] if a < b)
    df = spark.createDataFrame([(g,) for g in groups], f"members array<{kind}>")
    assert sorted((r["a"], r["b"], r["common"]) for r in graph.common_friends_of_groups(df, single).collect()) == expected
    assert graph.common_friends_of_groups(df.limit(0), single).collect() == []


def test_common_friends_lists_are_not_copied(spark, monkeypatch):
    """A list that went to each pair of blocks that it touches crossed the shuffle as often as there are blocks."""
    monkeypatch.setattr(graph, "CELL_ENTRIES", 20_000)  # 10 blocks
    ids = sorted(random.Random(1).sample(range(1_000_000), 300))
    df = spark.createDataFrame([(p, [f for f in ids if f != p]) for p in ids], "person long, friends array<long>")
    rows, written = shuffled(spark, lambda: graph.common_friends(df).select("a", "b", F.size("common").alias("n")).collect())
    assert len(rows) == 300 * 299 // 2
    assert {r["n"] for r in rows} == {298}
    assert 300 <= written < 600


@pytest.mark.parametrize("query", ["common_friends", "common_friends_text"])
def test_common_friends_shuffles_no_edges(spark, tmp_path, query):
    """All of 400 users in one minute: 159,600 edges, which don't cross a shuffle, as rows or in lists."""
    users = spark.range(400).selectExpr("id * 7919 % 100003 AS user_id", "timestamp'2024-01-01 00:00:30' AS ts")
    users.union(users.selectExpr("user_id", "CAST(NULL AS TIMESTAMP)")).union(users.selectExpr("CAST(NULL AS LONG)", "ts").limit(1)).write.parquet(f"{tmp_path}/events.parquet")
    rows, written = shuffled(spark, lambda: catalog.QUERIES[query](spark, str(tmp_path)).select("a", "b", F.size(F.split("common", " ")).alias("n")).collect(), "shuffleWriteBytes")
    assert len(rows) == 400 * 399 // 2
    assert {r["n"] for r in rows} == {398}
    assert written < 40_000


def test_relative_frequency(spark):
    got = {(r["word"], r["neighbour"]): r["frequency"] for r in cooccur.relative_frequency(spark.createDataFrame([("a b a c",), ("alone",)], "t string"), "t", 2).collect()}
    assert got == pytest.approx({("a", "a"): 2 / 5, ("a", "b"): 2 / 5, ("a", "c"): 1 / 5, ("b", "a"): 2 / 3, ("b", "c"): 1 / 3, ("c", "a"): 1 / 2, ("c", "b"): 1 / 2})


def test_weights(spark):
    counts = spark.createDataFrame([("u", "A", 4), ("u", "B", 1), ("u", "C", 1)], "adsl string, tag string, count long")
    current = tagging.normalise(counts, "count").select("adsl", "tag", "weight")
    assert [(t, str(w)) for _, t, w in rows(current)] == [("A", "0.50"), ("B", "0.25"), ("C", "0.25")]
    old = spark.createDataFrame([("u", "A", "0.5"), ("u", "D", "0.5"), ("v", "A", "0.5")], "adsl string, tag string, w string").selectExpr("adsl", "tag", "CAST(w AS DECIMAL(38,18)) weight")
    merged = rows(tagging.merge_previous(current, old))
    assert [(a, t, str(w)) for a, t, w in merged] == [("u", "A", "0.37"), ("u", "B", "0.20"), ("u", "C", "0.20"), ("u", "D", "0.24"), ("v", "A", "0.50")]
    top = dict(rows(tagging.render_top(tagging.merge_previous(current, old), most=2)))
    assert top == {"u": "A:0.370000,D:0.240000", "v": "A:0.500000"}


def test_dictionary_and_tags(spark):
    lines = spark.createDataFrame([("http://www.a.com/:x,y", 0), ("nocolon", 1), ("a.com:z", 2), (":bad", 3), ("b:8080:w", 4)], "value string, _line long")
    d = tagging.parse_dictionary(lines)
    assert {r["pattern"]: r["tags"] for r in d.collect()} == {"a.com": ["z"], "b:8080": ["w"]}
    visits = spark.createDataFrame([("u", "http://a.com/q", None), ("v", "http://b:8080/", "http://a.com")], "adsl string, url string, refer string")
    small = rows(tagging.keyword_tags(visits, "adsl", ["url", "refer"], d).select("adsl", "tags"))
    assert small == [("u", ["z"]), ("v", ["w", "z"])]
    many = d.unionByName(spark.range(tagging.SMALL).selectExpr("concat('none', id) pattern", "array('n') tags"))
    assert rows(tagging.keyword_tags(visits, "adsl", ["url", "refer"], many).select("adsl", "tags")) == small


def test_parse_visits(spark):
    lines = spark.createDataFrame([("\x01".join(["", "9.9.9.9", "u", "r", "agent", "x", "y"]),), ("ad1\tA:0.50,B:0.20",), ("junk",)], "value string")
    visits, old = tagging.parse_visits(lines)
    assert visits.select("adsl", "url").collect()[0] == ("9.9.9.9", "u")
    assert [(a, t, float(w)) for a, t, w in rows(old)] == [("ad1", "A", 0.5), ("ad1", "B", 0.2)]
