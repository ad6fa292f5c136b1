"""staylens: encounter analytics as Spark DataFrame operators.

Layers: `functions` (column expressions), `operators` (DataFrame ->
DataFrame steps), `sources` (scans, sinks, the derived raw table), `plans`
(cleaning, normalisation, encounter view, dashboard), `streaming`
(incremental ingest of raw files).
"""

__version__ = "0.1.0"
