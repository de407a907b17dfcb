"""Response streams: assembled texts, live rates and running totals, batch and streaming."""
