import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import stats, text


def one(spark, expr, **values):
    names = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], names).select(expr.alias("r")).first()["r"]


def column(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r["r"] for r in rows.select("i", f("c").alias("r")).orderBy("i").collect()]


def test_url_parts(spark):
    urls = ["http://www.baidu.com", "https://mail.163.com", "http://a.com/x/?q=1&b=2", "www.a.com/", "https://a.com:80/p", "http:///", None]
    assert column(spark, text.url_format, urls) == ["baidu.com", "mail.163.com", "a.com/x/?q=1&b=2", "a.com", "a.com:80/p", "", None]
    assert column(spark, text.url_host, urls) == ["www.baidu.com", "mail.163.com", "a.com", "www.a.com", "a.com:80", "/", None]
    assert column(spark, text.url_no_params, urls)[2] == "http://a.com/x/"


def test_is_ip(spark):
    values = ["127.9.0.1", "1232.232.444.424", "001.2.3.4", "1.2.3", "1.2.3.", "99999999999.1.1.1", "a.b.c.d", "255.255.255.255", "256.1.1.1"]
    assert column(spark, text.is_ip, values) == [True, False, True, False, False, False, False, True, False]


def test_host_domain(spark):
    f = lambda c: text.host_domain(c, ["com", "cn", "net"])
    assert column(spark, f, ["www.a.com.cn", "a.com:8080", "1.2.3.4:80", "a.com:x", "a:b:c", "com", "localhost", None]) == ["a.com.cn", "a.com", "1.2.3.4", "", "", "com", "localhost", None]


def test_params(spark):
    assert column(spark, text.query_params, ["http://a/?q=hello&x=abc&q=later%20on&novalue&y=a=b=c", "http://a/", None]) == [{"q": "later on", "y": "a=b=c"}, {}, None]
    assert column(spark, text.cookie_params, [" uid = 12345 ; k=abc; s=%E4%BD%A0%E5%A5%BD%E5%90%97%E5%95%8A"]) == [{"uid": "12345", "s": "你好吗啊"}]


def test_decode(spark):
    values = ["a%20b", "%u4f60%u597d", "\\u4f60", "%zz", "plain", None, "%u4f6"]
    assert column(spark, text.url_decode_lenient, values) == ["a b", "你好", "你", "", "plain", None, ""]


def test_split_and_trim(spark):
    assert column(spark, lambda c: text.jsplit(c, ","), ["a,b,,", ",a", "", ",,", "a", None]) == [["a", "b"], ["", "a"], [""], [], ["a"], None]
    assert column(spark, text.jtrim, ["\x01 a b\t\x00", "  ", None]) == ["a b", "", None]


def test_dates(spark):
    assert [str(x) if x else None for x in column(spark, text.parse_date, ["2024-02-29", "2013-13-45", "x", None])] == ["2024-02-29", None, None, None]
    assert column(spark, text.date_millis, ["1970-01-02", "bad"]) == [86_400_000, None]
    assert column(spark, text.seconds, ["1970-01-01 00:01:00", "bad"]) == [60, None]


def test_small_functions(spark):
    assert one(spark, text.weight_text(F.lit("t"), F.lit(0.33))) == "t:0.330000"
    assert one(spark, text.tail("c"), c="p f1 f2") == "f1,f2"
    assert one(spark, text.pair("c", "\t"), c="a\tb").asDict() == {"left": "a", "right": "b"}
    assert one(spark, text.join_pair(F.lit("a"), F.lit("b"), "-")) == "a-b"
    assert one(spark, text.merge_sums(F.expr("map(1, 2, 3, 4)"), F.expr("map(3, 1)"))) == {1: 2, 3: 5}
    assert one(spark, text.has_bits(text.set_bits(F.lit(1), 4), 4)) is True
    assert str(one(spark, text.half_up(F.lit("0.125")))) == "0.13"
    assert one(spark, text.running_mean(F.lit(3), F.lit(0))) is None
    rows = spark.createDataFrame([('{"name": "a", "age": 3}',), ("nonsense",), ('{"name": "b"}',)], "c string")
    got = rows.select(text.from_json_or_null("c", "name string, age int").alias("p")).filter("p IS NOT NULL").select("p.*").collect()
    assert sorted(map(tuple, got)) == [("a", 3), ("b", None)]


def test_sql_registration(spark):
    text.register(spark)
    got = spark.sql("SELECT url_format('http://www.a.com/') a, url_host('https://h/x') b, url_no_params('a?b') c, is_ip('1.2.3.4') d, url_decode_lenient('%u4f60') e").first()
    assert tuple(got) == ("a.com", "h", "a", True, "你")


@settings(max_examples=60, deadline=None)
@given(st.floats(0.5, 30), st.floats(0.5, 30), st.floats(0.01, 0.99))
def test_incomplete_beta_is_monotone_and_symmetric(a, b, x):
    v = stats.incomplete_beta(a, b, x)
    assert -1e-12 <= v <= 1 + 1e-12
    assert v == pytest.approx(1 - stats.incomplete_beta(b, a, 1 - x), abs=1e-9)


def test_t_test(spark):
    assert stats.two_sided_p(2.0, 1e9) == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-6)
    assert stats.two_sided_p(1.0, 1) == pytest.approx(0.5, rel=1e-9)
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("c", 9.0)], "g string, v double")
    got = stats.t_test(rows, "g", "v", "a", "b").first()
    assert got["df"] == 2 and got["t"] == pytest.approx((2 - 4) / math.sqrt(1 / 3))
    assert got["p"] == pytest.approx(0.0741799, rel=1e-4)
    assert math.isnan(stats.t_test(rows, "g", "v", "b", "c").first()["p"])
