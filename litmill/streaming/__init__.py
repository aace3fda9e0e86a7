"""The labelling log as a stream: parsing, keeping the last success, watermarked counts."""

from litmill.streaming.log import last_success, log_rates, pending, run_log_upserts, stale_share

__all__ = ["last_success", "log_rates", "pending", "run_log_upserts", "stale_share"]
