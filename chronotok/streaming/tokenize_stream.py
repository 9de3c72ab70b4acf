"""Incremental tokenization: token rows of a stream of events, with keyed state per person.

The state of a person is what the next token depends on: the last event's order and time, the
number of events and tokens so far, and the events that wait. An event is final when the person's
newest event is ``delay_minutes`` past it; final events are taken in the order of the batch
tokenizer, get their number and token offset, and leave the state. The end of a sequence stays
open: a ``close`` row of a person lets all its waiting events go, and EOS is set when the tokens
are read. An event that comes before one that has already left is *late*: it is passed on as a
late row, and reading the tokens takes the few persons with late rows from the batch
tokenizer, over all events.

So the tokens read are those of the batch tokenizer, whatever the order and the cutting of the
input. The state holds only numbers and waiting events; deciles, tokens and ids are Catalyst
expressions and stream-static joins around it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..functions.tokens import wall_micros
from ..operators import tokenize as T

EVENT_JSON = "ts timestamp_ntz, table_rank int, ev_id long, cid long, value_as_number double, unit_concept_id long, " \
             "et string, visit_type long, _decile int"
PLACED = "person_id long, kind string, ev_seq long, off long, first boolean, prev_micros long, event string"
STATE = "state string"
CLOSE = "close"
ORDER = ["table_rank", "ev_id", "cid", "value_as_number", "unit_concept_id"]
MINUTE = 60_000_000


def close_rows(persons: DataFrame) -> DataFrame:
    """One ``close`` row per person, to be added to the stream's input."""
    return persons.select("person_id", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit(CLOSE).alias("et"))


def gap_count(minutes: float) -> int:
    """How many gap tokens stand before an event."""
    if minutes < K.MIN_GAP_MINUTES:
        return 0
    return max(2, round(minutes / K.SIX_MONTHS_MINUTES)) if minutes > K.ONE_YEAR_MINUTES else 1


def _order(micros: int, event: str) -> list:
    """The sort key of the batch tokenizer: NULLs first, NaN last."""
    fields = json.loads(event)
    key: list = [micros]
    for name in ORDER:
        v = fields.get(name)
        key += [0, 0] if v is None else [2, 0] if isinstance(v, str) or math.isnan(v) else [1, v]
    return key


def _place(delay: int):
    """The state function: places final events, keeps the others, passes late ones on."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"last": None, "seq": 0, "off": 4, "newest": None, "waiting": []}
        waiting, out, closing = s["waiting"], [], False
        for frame in frames:
            for micros, body, event in zip(frame["micros"].tolist(), frame["n_body"].tolist(), frame["event"].tolist()):
                if json.loads(event)["et"] == CLOSE:
                    closing = True
                    continue
                place = _order(micros, event)
                if s["last"] is not None and place < s["last"]:
                    out.append((key[0], "late", 0, 0, False, 0, event))
                    continue
                waiting.append([place, body, event])
                s["newest"] = micros if s["newest"] is None else max(s["newest"], micros)
        waiting.sort(key=lambda w: w[0])
        n = len(waiting)
        if not closing:
            n = sum(1 for w in waiting if w[0][0] <= s["newest"] - delay)  # ascending by time
        for place, body, event in waiting[:n]:
            prev = s["last"][0] if s["last"] is not None else None
            s["seq"] += 1
            out.append((key[0], "event", s["seq"], s["off"], prev is None, prev or 0, event))
            s["off"] += body + (0 if prev is None else gap_count((place[0] - prev) / MINUTE))
            s["last"] = place
        s["waiting"] = waiting[n:]
        state.update((json.dumps(s),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLACED.split(", ")])

    return run


def placed_events(events: DataFrame, cuts: DataFrame, delay_minutes: int) -> DataFrame:
    """Streaming events (unified, and ``close`` rows) with their number and token offset in the person's sequence."""
    rows = T.with_decile(events.where(F.col("person_id").isNotNull()), cuts)
    body = (F.when(F.col("et") == "measurement", F.lit(3) + F.col("_decile").isNotNull().cast("int"))
            .when(F.col("et").isin("admission", *K.CLINICAL_TYPES), F.lit(2)).otherwise(F.lit(1)))
    names = [x.split()[0] for x in EVENT_JSON.split(", ")]
    sent = rows.select("person_id", wall_micros("ts").alias("micros"), body.alias("n_body"),
                       F.to_json(F.struct(*names)).alias("event"))
    return sent.groupBy("person_id").applyInPandasWithState(
        _place(delay_minutes * MINUTE), PLACED, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_tokens(events: DataFrame, cuts: DataFrame, out_dir: str, checkpoint_location: str, delay_minutes: int = 1440,
                  available_now: bool = True):
    """Start a query that appends placed and late events to ``out_dir``, one folder per micro-batch (a batch that is
    replayed replaces its own folder)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    writer = placed_events(events, cuts, delay_minutes).writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def read_tokens(spark: SparkSession, out_dir: str, events: DataFrame, demo: DataFrame, vocab: DataFrame, cuts: DataFrame,
                as_of_year: int = 2025) -> DataFrame:
    """The token table ``(person_id, pos, token, token_id, ts, ev_seq)`` of all persons of ``demo`` from the placed
    events, with EOS at each sequence's end. Persons with late events come from the batch tokenizer over ``events``."""
    placed = spark.read.parquet(out_dir).select([x.split()[0] for x in PLACED.split(", ")])
    late = placed.where(F.col("kind") == "late").select("person_id").distinct()
    fixed = T.fixed_ids(vocab)
    known = demo.join(late, "person_id", "left_anti")
    rows = placed.where(F.col("kind") == "event").join(known.select("person_id"), "person_id", "left_semi").select(
        "person_id", "ev_seq", "off", "first", "prev_micros", F.from_json("event", EVENT_JSON).alias("e")).select(
        "person_id", "ev_seq", "off", "first", "prev_micros", "e.*")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    prev = F.when(~F.col("first"), F.timestamp_add("MICROSECOND", F.col("prev_micros"), epoch))
    body = T.with_gaps(T.event_rows(rows, vocab), prev, fixed).select(
        "person_id", "ts", F.col("ev_seq").cast("int").alias("ev_seq"), "off",
        F.concat("_gaps", T.event_tokens(fixed)).alias("toks"))
    start = T.static_rows(known, vocab, as_of_year).select(
        "person_id", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("ev_seq"), F.lit(0).cast("long").alias("off"),
        T.static_tokens(fixed).alias("toks"))
    both = body.unionByName(start)
    ends = both.groupBy("person_id").agg(F.max(F.struct("ev_seq", "ts", (F.col("off") + F.size("toks")).alias("off"))).alias("e"))
    eos = F.array(T.known(fixed, K.EOS))
    rows = both.unionByName(ends.select("person_id", "e.ts", "e.ev_seq", "e.off", eos.alias("toks")))
    tokens = rows.select("person_id", "ev_seq", "ts", "off", F.posexplode("toks").alias("_slot", "_p")).select(
        "person_id", (F.col("off") + F.col("_slot")).cast("int").alias("pos"), F.col("_p.token").alias("token"),
        F.col("_p.id").alias("token_id"), "ts", "ev_seq")
    again = T.timeline_tokens(events.join(late, "person_id", "left_semi"), demo.join(late, "person_id", "left_semi"),
                              vocab, cuts, as_of_year)
    return tokens.unionByName(again.select(tokens.columns))
