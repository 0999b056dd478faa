"""Operators for training-data pipelines: extraction, dedup, packing, decontamination, archives, PII, chat, quality, licences."""
