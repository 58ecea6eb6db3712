"""Dead letters of records that are bad in more than one way."""

import duckdb

from brookframe.catalog import QUERIES, SQL


def test_a_record_bad_both_ways_fails_by_its_json(spark, tmp_path):
    """Event 72,035 is the first with cut-off JSON and cut-off headers; its poll is told the error of its SQL."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, 4 * i AS user_id, 'click' AS event_type, 1.5 AS value, '{{"k": ' || i % 97 || '}}' AS props
      FROM range(72030, 72041) t(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES["dead_letter_decode"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['dead_letter_decode']})").fetchall()
    assert len(want) == 11 and sorted(map(tuple, df.collect())) == sorted(want)
