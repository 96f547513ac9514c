"""The registered queries by area."""

from attestor.plans import claim_queries, dedupe_queries, gate_queries, profile_queries, promote_queries, provenance_queries, retrieval_queries, text_queries, watch_queries

REGISTRIES = [text_queries.registry, retrieval_queries.registry, claim_queries.registry, watch_queries.registry, dedupe_queries.registry, promote_queries.registry, gate_queries.registry, profile_queries.registry, provenance_queries.registry]
