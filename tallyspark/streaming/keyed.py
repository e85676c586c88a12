"""Keyed state: running cash and net shares of each portfolio, brought forward fact by fact.

Facts of a portfolio are numbered 1, 2, 3, ... by ``ord``. What arrives ahead of its turn is held
in the state until it is due; what came before is ignored, so a repeated file changes nothing. The
state is the balance, the last reset, the net shares by ticker and the held facts: its size follows
the tickers and the gaps, never the history. It lives in the checkpoint, so a restarted query goes
on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ledger import CASH_SIGN, SHARE
from ..shipping import ship

FACTS = "portfolio_id long, ord long, seq long, kind string, amount double, ticker string, shares double"
OUT = "portfolio_id long, ticker string, cash_micros long, n_after long, net_micro_shares long, applied long, held long"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def micros(x: float) -> int:
    """Half up, as everywhere."""
    return int((x * 1e6 + 0.5) // 1)


class Running(StatefulProcessor):
    """After each batch: a row of the portfolio (ticker null), and one of each ticker that moved."""

    def init(self, handle) -> None:
        self.balance = handle.getValueState("balance", "applied long, cash long, n_after long")
        self.shares = handle.getMapState("shares", "ticker string", "net long")
        self.waiting = handle.getMapState("waiting", "ord long", "kind string, amount double, ticker string, shares double")
        self.gaps = handle.getValueState("gaps", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        applied, cash, n_after = self.balance.get() or (0, 0, 0)
        held = (self.gaps.get() or (0,))[0]
        fresh: dict[int, tuple] = {}
        for part in rows:
            for r in part.itertuples(index=False):
                fresh[int(r.ord)] = (r.kind, None if pd.isna(r.amount) else float(r.amount), None if pd.isna(r.ticker) else r.ticker, None if pd.isna(r.shares) else float(r.shares))
        moved: dict[str, int] = {}
        while True:
            due = applied + 1
            fact = fresh.pop(due, None)
            if held and self.waiting.containsKey((due,)):
                fact = fact or tuple(self.waiting.getValue((due,)))
                self.waiting.removeKey((due,))
                held -= 1
            if fact is None:
                break
            applied = due
            kind, amount, ticker, shares = fact
            if kind == "CashReset":
                cash, n_after = micros(amount or 0.0), 0
            elif kind in CASH_SIGN:
                cash, n_after = cash + CASH_SIGN[kind] * micros(amount or 0.0), n_after + 1
            if ticker is not None and kind in ("BuyExecution", "SellExecution"):
                if ticker not in moved:
                    moved[ticker] = self.shares.getValue((ticker,))[0] if self.shares.containsKey((ticker,)) else 0
                moved[ticker] += (1 if kind == "BuyExecution" else -1) * round((shares or 0.0) * SHARE)
        for at, fact in fresh.items():
            if at > applied and not self.waiting.containsKey((at,)):
                self.waiting.updateValue((at,), fact)
                held += 1
        self.balance.update((applied, cash, n_after))
        self.gaps.update((held,))
        for ticker, net in moved.items():
            self.shares.updateValue((ticker,), (net,))
        names = [None, *moved]
        yield pd.DataFrame({
            "portfolio_id": [key[0]] * len(names), "ticker": names, "cash_micros": [cash] * len(names), "n_after": [n_after] * len(names),
            "net_micro_shares": pd.array([None, *moved.values()], "Int64"), "applied": [applied] * len(names), "held": [held] * len(names),
        })

    def close(self) -> None:
        pass


def running(facts: DataFrame) -> DataFrame:
    """A stream of facts (``FACTS``) as a stream of updates (``OUT``): of each key the last row counts.
    The session needs the state store of ``STORE``."""
    ship(facts.sparkSession)
    return facts.groupBy("portfolio_id").transformWithStateInPandas(Running(), OUT, "Update", "None")
