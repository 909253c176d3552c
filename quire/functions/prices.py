"""Token prices as Column expressions.

The price list is configuration, so it is folded into the plan as one CASE:
no join, no broadcast, and the whole ledger is priced in a narrow stage.
``operators.ledger.attach_prices`` is the join form for price tables that are
themselves data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.base import js_round


def _rate(model: Column, tokens: Column, prices: list, which: int) -> Column:
    """``which``: 1 input rate, 2 output rate."""
    def rates(tiers: list) -> Column:
        out = None
        for limit, *pair in tiers:
            value = F.lit(float(pair[which - 1]))
            if limit is None:
                return value if out is None else out.otherwise(value)
            test = tokens <= limit
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    return _by_model(model, [(name, rates(tiers)) for name, tiers, _ in prices])


def _by_model(model: Column, values: list[tuple[str, Column]]) -> Column:
    """Exact name first, then the longest name the model starts with."""
    chain = None
    for name, value in values:
        chain = F.when(model == name, value) if chain is None else chain.when(model == name, value)
    for name, value in sorted(values, key=lambda kv: -len(kv[0])):
        chain = chain.when(F.startswith(model, F.lit(name)), value)
    return chain


def matched_price(model: Column, prices: list = fv.PRICES) -> Column:
    return _by_model(model, [(name, F.lit(name)) for name, _, _ in prices])


def estimate_cost(
    model: Column, tokens_in: Column, tokens_out: Column, cached: Column, thinking: Column, prices: list = fv.PRICES
) -> Column:
    """USD, six decimals; NULL when no price fits the model."""
    rate_in = _rate(model, tokens_in, prices, 1)
    rate_out = _rate(model, tokens_in, prices, 2)
    cached_rates = [(name, F.lit(None if c is None else float(c)).cast("double")) for name, _, c in prices]
    rate_cached = F.coalesce(_by_model(model, cached_rates), rate_in)
    fresh = F.greatest(F.lit(0), tokens_in - cached)
    usd = (fresh * rate_in + cached * rate_cached + (tokens_out + thinking) * rate_out) / F.lit(1e6)
    return js_round(usd, 6)


def family_cost(
    model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, write_1h: Column, write_5m: Column
) -> Column:
    """Equivalent USD by model family (first family named in the model)."""
    def rate(which: int) -> Column:
        chain = None
        for row in fv.FAMILY_PRICES:
            hit, value = F.contains(model, F.lit(row[0])), F.lit(row[which])
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        return chain.otherwise(F.lit(fv.FAMILY_PRICES[-1][which]))

    price_in = rate(1)
    return (
        tokens_in * price_in
        + tokens_out * rate(2)
        + cache_read * price_in * F.lit(fv.CACHE_READ_FACTOR)
        + write_1h * price_in * F.lit(fv.CACHE_WRITE_1H_FACTOR)
        + write_5m * price_in * F.lit(fv.CACHE_WRITE_5M_FACTOR)
    ) / F.lit(1e6)


def with_price_overrides(overrides: dict, base: list = fv.PRICES) -> list:
    """Price list with an override file's entries; non-object entries are ignored."""
    merged = {name: (name, tiers, cached) for name, tiers, cached in base}
    for name, entry in (overrides or {}).items():
        if not isinstance(entry, dict):
            continue
        tiers = [tuple(t) for t in entry["tiers"]] if entry.get("tiers") else [(None, entry.get("input"), entry.get("output"))]
        if any(rate is None for t in tiers for rate in t[1:]):
            merged.pop(name, None)
            continue
        merged[name] = (name, tiers, entry.get("cached"))
    return list(merged.values())
