"""Declared schemas; nothing is inferred in production."""

from __future__ import annotations

ARCHIVE = "date STRING, data ARRAY<STRUCT<song: STRING, artist: STRING, this_week: INT, last_week: INT>>"
WEEKLY = "chart_date DATE, title STRING, artist STRING, this_week INT, last_week INT, loaded_at TIMESTAMP"
LYRICS = "title STRING, artist STRING, lrclib_id BIGINT, lrclib_title STRING, lrclib_artist STRING, plain_lyrics STRING, instrumental BOOLEAN, duration DOUBLE, match_score INT, match_method STRING, match_rules_version INT"
RECORDINGS = "title STRING, artist STRING, recording_mbid STRING, mb_title STRING, mb_artist STRING, first_release_date STRING, release_type STRING, recording_length_ms DOUBLE, genres STRING, genre_counts STRING, tags STRING, tag_counts STRING, artist_mbids STRING, genre_source STRING, match_score INT, match_method STRING, match_rules_version INT"
ARTISTS = "artist_mbid STRING, artist_name STRING, artist_type STRING, country STRING, gender STRING, begin_date STRING, genres STRING, genre_counts STRING, tags STRING, tag_counts STRING"
#: Response of a recording lookup.
RECORDING_RESPONSE = (
    "id STRING, title STRING, disambiguation STRING, `first-release-date` STRING, length DOUBLE, `artist-credit` ARRAY<STRUCT<name: STRING, joinphrase: STRING, artist: STRUCT<id: STRING>>>, "
    "genres ARRAY<STRUCT<name: STRING, count: INT>>, tags ARRAY<STRUCT<name: STRING, count: INT>>, releases ARRAY<STRUCT<date: STRING, `release-group`: STRUCT<id: STRING, `primary-type`: STRING>>>"
)
#: Response of an artist lookup.
ARTIST_RESPONSE = "id STRING, name STRING, type STRING, country STRING, gender STRING, `life-span` STRUCT<begin: STRING>, genres ARRAY<STRUCT<name: STRING, count: INT>>, tags ARRAY<STRUCT<name: STRING, count: INT>>"
