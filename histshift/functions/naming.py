"""Output column names."""

from __future__ import annotations


def quantile_names(prefix: str, quantiles) -> list[str]:
    """Decimal digits after '0.': 0.05 -> relds_05, 0.5 -> relds_5 (quirk Q15: relds_5 is the median)."""
    return [f"{prefix}_{repr(float(q)).split('.', 1)[1]}" for q in quantiles]


def percent_names(quantiles) -> list[str]:
    """'5%', '25%', … as in the client-mean quantile table."""
    return [f"q{round(q * 100):02d}" for q in quantiles]
