"""One quantity recorded in different units, converted to a common one.

Units that the text states are read from it.  Where it states none, the scale
is a hidden state: each device (a feed) is a hidden Markov chain over its rows
in order, the states are what a unit may be (scale and basis), and a row's
observation is how far the logarithm of its value lies from a smooth level of
the feed.  Viterbi's algorithm decodes the states from the jumps; how often a
feed switches, how far its values scatter and where its level lies are learned
from the feed itself by decoding several times.  So a feed that writes single
rows in thousands is read row by row, and one that switches for a stretch is
read as a stretch, within which doubtful rows go with their neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.functions.money import with_price
from kvartal.sources.tables import stored

#: Hidden units: scale, and whether the amount is for a square metre.
STATES = ((1.0, False), (1e3, False), (1e6, False))
STATES_WITH_BASIS = (*STATES, (1.0, True))
STAY = 0.9
#: Scatter of log10 values about the level: as first assumed, and the bounds within which it is learned.
SPREAD, LEAST_SPREAD, MOST_SPREAD = 0.15, 0.05, 1.0
#: Rows that the assumed switches weigh as against those seen.
PRIOR_ROWS = 20.0
ROUNDS = 4
SMOOTH_ROWS = 501
SESSION_ROWS = 65_536


def moves(stay: float, states: int) -> np.ndarray:
    """Log probabilities of going from one state to another, all switches alike."""
    out = np.full((states, states), np.log((1 - stay) / max(1, states - 1)))
    np.fill_diagonal(out, np.log(stay))
    return out


def viterbi(emission: np.ndarray, move: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Most likely states of one chain, ``emission`` [n, states] and ``move`` [from, to] in log; chunks advance side by side.

    Each chunk is decoded for every state before it, then the chunks are
    chained; the result is that of the plain recursion.
    """
    n, k = emission.shape
    if n == 0:
        return np.empty(0, dtype=np.int64)
    m = -(-n // chunk)
    e = np.zeros((m * chunk, k))
    e[:n] = emission
    e = e.reshape(m, chunk, k)
    score = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(m, axis=0)
    back = np.empty((chunk, m, k, k), dtype=np.int8)
    for t in range(chunk):
        step = score[:, :, :, None] + move[None, None]
        back[t] = step.argmax(axis=2)
        score = step.max(axis=2) + e[:, t][:, None, :]
    at, came = np.zeros(k), np.empty((m, k), dtype=np.int64)
    for i in range(m):
        reach = at[:, None] + score[i]
        came[i], at = reach.argmax(axis=0), reach.max(axis=0)
    end, start = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    s = int(at.argmax())
    for i in range(m - 1, -1, -1):
        end[i], start[i] = s, came[i, s]
        s = start[i]
    out, now, rows = np.empty((m, chunk), dtype=np.int64), end.copy(), np.arange(m)
    for t in range(chunk - 1, -1, -1):
        out[:, t] = now
        now = back[t][rows, start, now]
    return out.reshape(-1)[:n]


def _moving_mean(values: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Mean of the counted values within ``width`` rows around each."""
    total, number = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.where(counts, values, 0.0), counts))
    a = np.maximum(0, np.arange(len(values)) - width // 2)
    b = np.minimum(len(values), a + width)
    return (total[b] - total[a]) / np.maximum(1, number[b] - number[a])


def decode_units(residual: np.ndarray, said: np.ndarray, shifts: np.ndarray, stay: float = STAY, spread: float = SPREAD, smooth: int = SMOOTH_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """State of each row; ``residual`` is log10 of the value as written less its expected level.

    ``shifts`` [rows, states] is what a state adds to the log10 value; NaN
    where a row can't be in it.  Rows whose unit is said are in the first
    state.  Each round decodes the chain, then learns from it the smooth level
    of the device, the scatter about it and the rates of switching.
    """
    n, k = shifts.shape
    known, possible = np.isfinite(residual), np.isfinite(shifts)
    r, shift = np.where(known, residual, 0.0), np.where(possible, shifts, 0.0)
    drift = np.full(n, np.median(r[known]) if known.any() else 0.0)
    move, state = moves(stay, k), np.zeros(n, dtype=np.int64)
    for _ in range(rounds):
        e = -np.abs((r - drift)[:, None] + shift) / spread
        e[~known] = 0.0
        e[~possible] = -1e6
        e[said, 1:] = -1e6
        now = viterbi(e, move)
        if _ and (now == state).all():
            break
        state = now
        rest = r + shift[np.arange(n), state]
        drift = _moving_mean(np.clip(rest - np.median(rest[known]) if known.any() else rest, -0.5, 0.5), known, smooth) + (np.median(rest[known]) if known.any() else 0.0)
        if known.any():
            spread = float(np.clip(np.median(np.abs(rest - drift)[known]) / np.log(2), LEAST_SPREAD, MOST_SPREAD))
        seen = np.zeros((k, k))
        np.add.at(seen, (state[:-1], state[1:]), 1.0)
        seen += PRIOR_ROWS * np.exp(moves(stay, k))
        move = np.log(seen / seen.sum(axis=1, keepdims=True))
    return state


def prices_in_manat(listings: DataFrame, fx_rates: DataFrame, session_rows: int = SESSION_ROWS, states=STATES) -> DataFrame:
    """Total price in manat of every row whose price is readable.

    Returns ``row_no, price_manat`` (double, unrounded), ``code``, ``scale``,
    ``per_m2`` and ``other_unit`` (recorded in another currency, scale or basis
    than manat for the whole flat).

    A price for each square metre times the row's ``area``; foreign money at
    the rate of ``listed_month``; rows where one of these is missing have no
    total and are left out, as are unreadable prices and amounts of zero.  A
    repeated row gives a repeated result.  The expected level is the median of log10
    of what the text says in the row's ``h3`` (of all rows where that is NULL),
    adjusted for area within a factor of three, plus the smooth level of the
    feed that :func:`decode_units` finds.  ``states`` are the units that an
    amount without words may have; a basis of square metres needs an area.
    Devices are the feeds; a feed's chain is cut into sessions of
    ``session_rows`` row numbers, so no task gets a whole feed.  Empty tables
    give an empty result.
    """
    base = stored(
        with_price(listings.select("row_no", "h3", "listed_month", F.coalesce("source", F.lit("")).alias("device"), F.when(F.col("area") > 0, F.col("area")).alias("area"), "price", "currency"))
        .where(F.col("amount") > 0)
        .drop("price", "currency"),
        "prices",
    )
    rates = fx_rates.groupBy(F.col("currency").alias("code"), F.col("rate_month").alias("listed_month")).agg(F.max("azn_per_unit").alias("rate"))
    rows = (
        base.join(rates, ["code", "listed_month"], "left")
        .withColumn("rate", F.when(F.col("code") == "AZN", 1.0).otherwise(F.col("rate")))
        .withColumn("written", F.col("amount") * F.col("scale") * F.col("rate") * F.when(F.col("per_m2"), F.col("area")).otherwise(1.0))
        .where(F.col("written") > 0)
    )
    log = F.log10("written")
    levels = rows.groupBy("h3").agg(F.percentile_approx(log, 0.5, 1000).alias("level"), F.percentile_approx("area", 0.5, 1000).alias("usual_area"))
    everywhere = rows.agg(F.percentile_approx(log, 0.5, 1000).alias("level_all"), F.percentile_approx("area", 0.5, 1000).alias("area_all"))
    usual = F.coalesce("usual_area", "area_all")
    fit = F.coalesce(F.greatest(F.lit(1 / 3), F.least(F.lit(3.0), F.col("area") / usual)), F.lit(1.0))
    seen = (
        rows.join(levels, rows["h3"].eqNullSafe(levels["h3"]), "left")
        .crossJoin(F.broadcast(everywhere))  # one row
        .select(
            "row_no", "device", F.floor(F.col("row_no") / session_rows).alias("session"), "code", "scale", "per_m2", "scale_said", "written", F.log10("area").alias("log_area"),
            (log - F.coalesce("level", "level_all") - F.log10(fit)).alias("residual"),
        )
    )

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_no", "written"], kind="stable")
        log_area = pdf["log_area"].to_numpy(dtype=float)
        shifts = np.stack([np.log10(scale) + (log_area if basis else np.zeros(len(pdf))) for scale, basis in states], axis=1)
        state = decode_units(pdf["residual"].to_numpy(dtype=float), pdf["scale_said"].to_numpy(dtype=bool), shifts)
        scale, basis = (np.array(x)[state] for x in zip(*states))
        scale, per_m2 = pdf["scale"].to_numpy() * scale, pdf["per_m2"].to_numpy(dtype=bool) | basis
        total = pdf["written"].to_numpy() * 10 ** shifts[np.arange(len(pdf)), state]
        exact = pdf["written"].to_numpy() * np.array([s for s, _ in states])[state]
        return pd.DataFrame(
            {"row_no": pdf["row_no"], "price_manat": np.where(basis, total, exact), "code": pdf["code"], "scale": scale, "per_m2": per_m2, "other_unit": (pdf["code"] != "AZN") | (scale != 1.0) | per_m2}
        )

    return seen.groupBy("device", "session").applyInPandas(decode, "row_no long, price_manat double, code string, scale double, per_m2 boolean, other_unit boolean")
