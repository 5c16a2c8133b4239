"""Streams: revision events replayed store by store, and loss counts by windows of time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import BLOCKING
from ..operators.ledger import EVENT, OUTCOMES, Revision, Store, fold


def _spelled(store: Store | None) -> str:
    row = lambda r: [r.number, r.semantic_sha256, r.graph_json, r.message]
    return json.dumps(None if store is None else [[row(r) for r in store.revisions], store.position, {k: row(r) for k, r in store.drafts.items()}])


def _read(text: str) -> Store | None:
    if (found := json.loads(text)) is None:
        return None
    revisions, position, drafts = found
    return Store(tuple(Revision(*r) for r in revisions), position, {k: Revision(*r) for k, r in drafts.items()})


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    store, out = fold(_read(state.get[0]) if state.exists else None, pd.concat(list(batches))[EVENT])
    state.update((_spelled(store),))
    yield out


def replay_stream(events: DataFrame) -> DataFrame:
    """Outcomes of each batch's events. A store's state is its revisions, cursor and open transactions, so a batch
    costs its own events, however many came before.

    Events of a store must come in order of seq over batches; in a batch they may come in any order.
    """
    return events.groupBy("store_id").applyInPandasWithState(_advance, OUTCOMES, "store string", "append", GroupStateTimeout.NoTimeout)


def loss_windows(records: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, category, n, n_blocking) of loss records (ts, category, severity), for batches and streams alike."""
    found = records.withWatermark("ts", late) if records.isStreaming else records
    by = found.groupBy(F.window("ts", width).alias("w"), "category")
    return by.agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin(*BLOCKING)).alias("n_blocking")).select(F.col("w.start").alias("start"), "category", "n", "n_blocking")
