"""Streams: the compressors on unbounded inputs, windowed kind counts, incremental digests."""
