"""Nothing here: every input of this engine is bounded.

A global sort has no append-mode streaming form, so unbounded inputs are sorted per closed batch
with ``sortweave.operators.runs`` and merged with ``sortweave.operators.merge``.
"""
