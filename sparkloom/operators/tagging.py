"""User tags: keyword matching, weights, day-over-day decay, ranking and rendering."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import half_up, jsplit, url_format, url_host, weight_text
from ..session import ship

#: A previous day's weight counts for this much today; tags below LEAST go, MOST stay at most.
DECAY, LEAST, MOST = "0.7", 0.005, 10
#: Dictionaries up to this many patterns are matched in the JVM, larger ones by an automaton.
SMALL = 300
#: Patterns an automaton may hold in a worker; it is shipped to each, so its size is checked.
LARGEST = 2_000_000
_SQRT = "decimal(38,18)"


def load_dictionary(spark: SparkSession, path: str, format_url: bool = True) -> DataFrame:
    """(pattern, tags) from lines ``pattern:tag,tag``, cut at the last colon; of equal patterns the last line counts."""
    return parse_dictionary(spark.read.text(path).withColumn("_line", F.monotonically_increasing_id()), format_url)


def parse_dictionary(lines: DataFrame, format_url: bool = True) -> DataFrame:
    """``lines``: (value, _line)."""
    cut = F.regexp_extract("value", r"^(.+):([^:]*)$", 1)
    pattern = url_format(cut) if format_url else cut
    rows = lines.filter(F.col("value").rlike(r"^.+:[^:]*$")).select(pattern.alias("pattern"), jsplit(F.regexp_extract("value", r"^(.+):([^:]*)$", 2), ",").alias("tags"), "_line")
    return rows.filter("pattern != ''").groupBy("pattern").agg(F.max_by("tags", "_line").alias("tags"))


def keyword_tags(df: DataFrame, key: str, texts: Sequence[str], dictionary: DataFrame, out: str = "tags") -> DataFrame:
    """``df`` with the distinct sorted tags of all patterns that occur in any of ``texts``.

    A small dictionary becomes an expression; a larger one an automaton in each Python worker, which reads a text once
    whatever the number of patterns.
    """
    n = dictionary.count()
    if n > LARGEST:
        raise ValueError(f"{n} patterns don't fit a worker; split the dictionary")
    entries = [(r["pattern"], list(r["tags"])) for r in dictionary.collect()]
    if not entries:
        return df.withColumn(out, F.array().cast("array<string>"))
    if n <= SMALL:
        hits = [F.when(_any([F.coalesce(F.contains(F.col(t), F.lit(p)), F.lit(False)) for t in texts]), F.array(*map(F.lit, tags))) for p, tags in entries]
        found = F.flatten(F.filter(F.array(*hits), lambda x: x.isNotNull()))
        return df.withColumn(out, F.array_sort(F.array_distinct(found)))
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, entries))

    @F.pandas_udf("array<string>")
    def match(*columns: pd.Series) -> pd.Series:
        find = automaton(*shared.value)
        return pd.Series([sorted({tag for text in row if text for tags in find(text) for tag in tags}) for row in zip(*columns, strict=True)])

    return df.withColumn(out, match(*[F.col(t) for t in texts]))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


_automata: dict[str, object] = {}


def automaton(key: str, entries: list[tuple[str, list[str]]]):
    """A function from a text to the tags of each pattern in it; the last one made stays with the worker."""
    if key not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for p, tags in entries:
            made.add_word(p, tags)
        made.make_automaton()
        _automata.clear()
        _automata[key] = lambda text: [tags for _, tags in made.iter(text)]
    return _automata[key]


def parse_visits(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Visits (adsl, ip, url, refer, user_agent) and a previous day's rows (adsl, tag, weight) from mixed lines.

    Seven or more fields between U+0001 are a visit, whose empty adsl gives way to its ip; else two fields between
    tabs are a previous row.  Other lines are skipped.
    """
    fields = lines.withColumn("_v", jsplit(line, "\x01")).withColumn("_p", jsplit(line, "\t"))
    at = lambda i: F.get("_v", F.lit(i))
    visits = fields.filter(F.size("_v") >= 7).select(F.when(at(0) == "", at(1)).otherwise(at(0)).alias("adsl"), at(1).alias("ip"), at(2).alias("url"), at(3).alias("refer"), at(4).alias("user_agent"))
    old = fields.filter((F.size("_v") < 7) & (F.size("_p") == 2)).select(F.get("_p", 0).alias("adsl"), F.explode(jsplit(F.get("_p", 1), ",")).alias("_t"))
    old = old.filter(F.col("_t").rlike("^.+:[^:]+$")).select("adsl", F.regexp_extract("_t", "^(.+):([^:]+)$", 1).alias("tag"), F.regexp_extract("_t", "^(.+):([^:]+)$", 2).try_cast("decimal(38,18)").alias("weight"))
    return visits, previous_weights(old.filter("weight IS NOT NULL"))


def previous_weights(old: DataFrame) -> DataFrame:
    """One row for each (adsl, tag): the greatest weight."""
    return old.groupBy("adsl", "tag").agg(F.max("weight").alias("weight"))


def visit_tags(visits: DataFrame, url_dictionary: DataFrame, agent_dictionary: DataFrame) -> DataFrame:
    """(adsl, tag) for each tag of each visit: URL patterns in url and refer, agent patterns in the user agent.  Hosts
    are parts of the addresses, so they add nothing."""
    tagged = keyword_tags(visits, "adsl", ["url", "refer"], url_dictionary, "_u")
    tagged = keyword_tags(tagged, "adsl", ["user_agent"], agent_dictionary, "_a")
    return tagged.select("adsl", F.explode(F.array_distinct(F.concat("_u", "_a"))).alias("tag"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("adsl", "tag").agg(F.count("*").alias("count"))


def normalise(df: DataFrame, value: str, out: str = "weight") -> DataFrame:
    """Each value's square root over the sum of its adsl's, to two decimals half up."""
    root = F.sqrt(F.col(value).cast("double")).cast(_SQRT)
    share = F.try_divide(F.col("_root").cast("double"), F.sum("_root").over(W.partitionBy("adsl")).cast("double"))
    return df.withColumn("_root", root).withColumn(out, half_up(share)).drop("_root")


def merge_previous(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Today's weights plus ``DECAY`` times yesterday's, normalised again; who has no tag today keeps yesterday's
    weights as they are.  Both: (adsl, tag, weight)."""
    decayed = F.col("_old").cast("decimal(20,6)") * F.lit(DECAY).cast("decimal(2,1)")
    both = current.select("adsl", "tag", F.col("weight").cast("decimal(20,6)").alias("_new")).join(previous.select("adsl", "tag", F.col("weight").alias("_old")), ["adsl", "tag"], "full")
    rows = both.withColumn("_today", F.count("_new").over(W.partitionBy("adsl")) > 0)
    rows = rows.withColumn("_sum", F.coalesce("_new", F.lit(0).cast("decimal(20,6)")) + F.coalesce(decayed, F.lit(0).cast("decimal(20,6)")))
    out = normalise(rows, "_sum", "_w")
    return out.select("adsl", "tag", F.when(F.col("_today"), F.col("_w")).otherwise(half_up("_old")).alias("weight"))


def render_top(weights: DataFrame, most: int = MOST, least: float = LEAST) -> DataFrame:
    """(adsl, tags): the best tags as ``tag:0.330000,...``, by weight then tag; adsls without any go."""
    rank = F.row_number().over(W.partitionBy("adsl").orderBy(F.desc("weight"), F.asc("tag")))
    best = weights.filter(F.col("weight") >= F.lit(least)).withColumn("_rank", rank).filter(F.col("_rank") <= most)
    items = F.array_sort(F.collect_list(F.struct("_rank", weight_text("tag", "weight").alias("_t"))))
    return best.groupBy("adsl").agg(items.alias("_i")).select("adsl", F.array_join("_i._t", ",").alias("tags"))


def host_pv(visits: DataFrame, key: str = "adsl", url: str = "url") -> DataFrame:
    """(key, host, pv): page views by host, in order of key and host."""
    return visits.withColumn("host", url_host(url)).groupBy(key, "host").agg(F.count("*").alias("pv")).orderBy(key, "host")


def user_tags(lines: DataFrame, url_dictionary: DataFrame, agent_dictionary: DataFrame) -> DataFrame:
    """The whole pipeline: mixed lines in, (adsl, tags) out."""
    visits, previous = parse_visits(lines)
    current = normalise(tag_counts(visit_tags(visits, url_dictionary, agent_dictionary)), "count")
    return render_top(merge_previous(current.select("adsl", "tag", "weight"), previous))
