"""Training-data operators: quality, extraction, near duplicates, packing, scoring, counting, media, decontamination, language and chat.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
