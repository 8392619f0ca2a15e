"""Sequential folds: a portfolio over ordered bars, and account state from events.

Each series (symbol, trial, account) is a fold of its own; the state of a fold
is small whatever its length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def portfolio(
    bars: DataFrame, threshold: float, target: float = 1.0, stop: float = 2.0, horizon: int = 6, balance: float = 10000.0,
    risk: float = 0.01, most_stops: int = 3, pause: int = 12, by: str = "symbol",
) -> DataFrame:
    """Long trades where score >= threshold, one at a time: the trade log.

    A trade ends at its target, its stop (checked after the target on one bar),
    or after `horizon` bars. After `most_stops` stops in a row there are `pause`
    bars without a trade. Size is balance * risk over the stop distance.
    """
    kind = {f.name: f.dataType.simpleString() for f in bars.schema}
    schema = f"`{by}` {kind[by]}, entry {kind['bucket']}, exit {kind['bucket']}, entry_price double, exit_price double, lots double, pnl double, reason string, balance double, drawdown double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", kind="stable")
        t, price, atr, score = (pdf[c].to_numpy() for c in ("bucket", "close", "atr", "score"))
        money, peak, row, stops, until, out = balance, balance, 0, 0, -1, []
        while row < len(t):
            if score[row] < threshold or row < until:
                row += 1
                continue
            entry, up, down = price[row], price[row] + target * atr[row], price[row] - stop * atr[row]
            end, why = min(len(t) - 1, row + horizon), "time"
            for k in range(row + 1, end + 1):
                if price[k] >= up or price[k] <= down:
                    end, why = k, "target" if price[k] >= up else "stop"
                    break
            lots = max(0.01, int(money * risk / (stop * atr[row] + 1e-10) * 100 + 1e-9) / 100)
            pnl = (price[end] - entry) * lots
            money += pnl
            peak = max(peak, money)
            stops = stops + 1 if why == "stop" else 0
            if stops >= most_stops:
                until, stops = end + pause, 0
            out.append((pdf[by].iloc[0], t[row], t[end], entry, price[end], lots, pnl, why, money, (peak - money) / peak if peak else 0.0))
            row = max(end, row + 1)
        return pd.DataFrame(out, columns=[by, "entry", "exit", "entry_price", "exit_price", "lots", "pnl", "reason", "balance", "drawdown"])

    return bars.select(by, "bucket", "close", "atr", "score").groupBy(by).applyInPandas(run, schema)


def step(state: dict, kind: str, ticket: int, amount: float) -> dict:
    """One event on an account's state: open tickets, equity, runs of stops, peak."""
    if kind == "FILL":
        state["open"].add(ticket)
    elif kind in ("CLOSE", "SL", "TP"):
        state["open"].discard(ticket)
        state["stops"] = state["stops"] + 1 if kind == "SL" else 0
    elif kind == "EQUITY":
        state["equity"] = amount
        state["peak"] = max(state["peak"], amount)
    state["events"] += 1
    return state


def fold_events(events: DataFrame) -> DataFrame:
    """Final state of each account from its events in order of seq."""
    kind = events.schema["account"].dataType.simpleString()
    schema = f"account {kind}, events bigint, open_tickets int, consecutive_stops int, equity double, peak double, drawdown double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = {"open": set(), "stops": 0, "equity": 0.0, "peak": 0.0, "events": 0}
        pdf = pdf.sort_values("seq", kind="stable")
        for kind, ticket, amount in zip(pdf["kind"], pdf["ticket"], pdf["amount"]):
            state = step(state, kind, int(ticket), float(amount))
        down = (state["peak"] - state["equity"]) / state["peak"] if state["peak"] else 0.0
        return pd.DataFrame([(key[0], state["events"], len(state["open"]), state["stops"], state["equity"], state["peak"], down)],
                            columns=["account", "events", "open_tickets", "consecutive_stops", "equity", "peak", "drawdown"])

    return events.groupBy("account").applyInPandas(run, schema)
