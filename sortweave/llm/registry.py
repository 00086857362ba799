"""Queries of this subpackage, and SQL where it can state their results."""

from __future__ import annotations

import corpus_pipeline
from sortweave.llm import curriculum, hilbert_pack, imatch, kmeans_dedup, language_id, lattice_lm, license_scan, orc_ids, simhash, warc_index

QUERIES = {
    f.__name__: f
    for f in (
        hilbert_pack.op1_hilbert_pack,
        imatch.op2_imatch_fingerprints,
        license_scan.op3_license_digests,
        lattice_lm.op4_subword_lattice_lm,
        simhash.op5_simhash_anchor_dedup,
        orc_ids.op6_orc_token_ids,
        language_id.op7_kneser_ney_language,
        warc_index.op8_warc_index_merge,
        curriculum.op9_curriculum_mix,
        kmeans_dedup.op10_spherical_kmeans_dedup,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op3_license_digests": license_scan.sql(), "op8_warc_index_merge": warc_index.OP8_SQL, "op9_curriculum_mix": curriculum.OP9_SQL}
