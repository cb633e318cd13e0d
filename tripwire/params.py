"""Job parameters (thresholds and limits).  Defaults are the reference values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanParams:
    # Fixed values (defaults that must equal the reference's for equal results)
    entropy_threshold: float = 4.5      # bits per symbol, blobs of >= 24 chars
    combining_ratio: float = 0.05       # share of combining marks for Zalgo
    morse_token_ratio: float = 0.60     # share of dot/dash tokens
    min_scan_length: int = 8            # shorter inputs only get TOO_SHORT


@dataclass(frozen=True)
class PolicyParams:
    # Fixed values (reference defaults)
    single_limit: float = 500.0
    daily_limit: float = 2000.0
    eth_usd: float = 3000.0
