"""Schemas of the persistent relations and of the operators' inputs."""

from __future__ import annotations

ENTITY = "id string, kind string, label string, aliases array<string>, created_at timestamp"
MENTION = "id string, source_id string, kind string, surface_form string, span_start int, span_end int, candidate_label string, entity_id string, status string, confidence double, created_at timestamp"
EDGE = "id string, source_entity_id string, target_entity_id string, predicate string, valid_at timestamp, invalid_at timestamp, recorded_at timestamp, expired_at timestamp, support array<string>"
EPISODE = "id string, source_id string, ingested_at timestamp, mention_ids array<string>"
CANDIDATE = "ref string, kind string, label string, aliases array<string>, context string, ordinal long"
DECISION = "surface string, kind string, entity_id string, decision string, context string, seq long"
FACT = "source_entity_id string, target_entity_id string, predicate string, valid_at timestamp, support array<string>, ordinal long"
POLICY = "predicate string, cardinality string"
EXTRACTED = "kind string, surface_form string, span_start int, span_end int, candidate_label string, candidate_id string, confidence double"
