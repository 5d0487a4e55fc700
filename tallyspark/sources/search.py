"""Search services as a data source, with a client that is handed in.

The client does the calls; retries, back-off and pacing are here. One partition keeps a global rate
limit; a service without one may be asked from many.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyspark.functions import text as tx
from tallyspark.sources import schemas

#: Pacing and tries of the two services.
PACE_RECORDINGS, TRIES_RECORDINGS, BACKOFF_RECORDINGS = 1.05, 5, 2.0
PACE_LYRICS, TRIES_LYRICS, BACKOFF_LYRICS = 0.5, 3, 1.0


class NotFound(Exception):
    """The service knows no such thing; not worth another try."""


def with_retries(call: Callable[[], object], tries: int, backoff: float, sleep: Callable[[float], None] = time.sleep) -> object | None:
    """The call's result; doubled pauses between tries; None if there is no such thing."""
    for k in range(tries):
        try:
            return call()
        except NotFound:
            return None
        except OSError:
            if k + 1 == tries:
                raise
            sleep(backoff * 2**k)
    return None


def _client(options: dict) -> Callable[[str], list]:
    """The client: made by a function named "module:function", which the executors import, or one that answers from a file."""
    if "client" in options:
        module, _, name = options["client"].partition(":")
        return getattr(importlib.import_module(module), name)()
    return _offline(options["responses"])


def _offline(folder: str) -> Callable[[str], list]:
    """A client that answers from a JSON file of queries and responses."""
    with open(folder) as f:
        known = json.load(f)
    return lambda q: known.get(q, [])


class _Part(InputPartition):
    def __init__(self, queries: list[str]):
        self.queries = queries


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = json.loads(options["queries"])
        self.options = {k: options[k] for k in ("client", "responses") if k in options}
        self.pace = float(options.get("pace", "0"))
        self.tries = int(options.get("tries", "3"))
        self.backoff = float(options.get("backoff", "1"))
        self.parts = int(options.get("parts", "1"))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.parts, len(self.queries)))
        return [_Part(self.queries[k::n]) for k in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        client = _client(self.options)
        for q in partition.queries:
            found = with_retries(lambda q=q: client(q), self.tries, self.backoff) or []
            for k, r in enumerate(found):
                yield (q, k, json.dumps(r))
            if self.pace:
                time.sleep(self.pace)


class SearchSource(DataSource):
    """format "search": options queries (JSON list), client (module:function) or responses (file of answers), pace, tries, backoff, parts."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "query STRING, rank INT, response STRING"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


def search(spark: SparkSession, queries: list[str], responses: str | None = None, **options: str) -> DataFrame:
    """Answers of a service; give a client (module:function) or a file of responses."""
    spark.dataSource.register(SearchSource)
    given = options | ({"responses": responses} if responses is not None else {})
    return spark.read.format("search").options(queries=json.dumps(queries), **given).load()


def _by_votes(c: str) -> Column:
    return F.array_sort(F.coalesce(F.col(c), F.array()), lambda x, y: F.when(x["count"] > y["count"], -1).when(x["count"] < y["count"], 1).otherwise(0))


def _packed(c: str, field: str) -> Column:
    return F.array_join(F.transform(_by_votes(c), lambda x: x[field].cast("string")), "|")


def artist_rows(responses: DataFrame) -> DataFrame:
    """Artist rows from raw responses, genres and tags by votes."""
    r = responses.select("query", "rank", F.from_json("response", schemas.ARTIST_RESPONSE).alias("r")).select("query", "rank", "r.*")
    return r.select(
        "query", "rank", F.col("id").alias("artist_mbid"), F.col("name").alias("artist_name"), F.col("type").alias("artist_type"), "country", "gender", F.col("life-span")["begin"].alias("begin_date"),
        _packed("genres", "name").alias("genres"), _packed("genres", "count").alias("genre_counts"), _packed("tags", "name").alias("tags"), _packed("tags", "count").alias("tag_counts"),
    )


def song_rows(responses: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Recording rows from raw responses: credit line, earliest release, genres by votes, ids of the acts.

    A recording without genres takes those of its earliest release's group from groups (group_id, genres, genre_counts), else its
    own tags.
    """
    r = responses.select("query", "rank", F.from_json("response", schemas.RECORDING_RESPONSE).alias("r")).select("query", "rank", "r.*")
    dated = F.filter("releases", lambda x: F.length(F.coalesce(x["date"], F.lit(""))) > 0)
    first = F.array_min(F.transform(dated, lambda x: F.struct(x["date"].alias("date"), x["release-group"]["primary-type"].alias("kind"), x["release-group"]["id"].alias("id"))))
    r = r.withColumn("first", first)
    if groups is None:
        r = r.withColumns({"g_genres": F.lit(None).cast("string"), "g_counts": F.lit(None).cast("string")})
    else:
        g = groups.groupBy(F.col("group_id").alias("g_id")).agg(F.min_by("genres", "genres").alias("g_genres"), F.min_by("genre_counts", "genres").alias("g_counts"))
        r = r.join(g, F.col("first.id") == F.col("g_id"), "left")
    has, group = F.size(F.coalesce("genres", F.array())) > 0, F.length(F.coalesce("g_genres", F.lit(""))) > 0
    return r.select(
        "query",
        "rank",
        F.col("id").alias("recording_mbid"),
        F.col("title").alias("mb_title"),
        tx.build_credit(F.col("artist-credit")).alias("mb_artist"),
        F.coalesce(F.nullif("first-release-date", F.lit("")), F.col("first.date")).alias("first_release_date"),
        F.col("first.kind").alias("release_type"),
        F.col("length").alias("recording_length_ms"),
        F.when(has, _packed("genres", "name")).when(group, F.col("g_genres")).otherwise(_packed("tags", "name")).alias("genres"),
        F.when(has, _packed("genres", "count")).when(group, F.col("g_counts")).otherwise(_packed("tags", "count")).alias("genre_counts"),
        F.array_join(F.transform("artist-credit", lambda x: x["artist"]["id"]), "|").alias("artist_mbids"),
        F.when(has, "recording").when(group, "release-group").when(F.size(F.coalesce("tags", F.array())) > 0, "tags").otherwise("none").alias("genre_source"),
    )
