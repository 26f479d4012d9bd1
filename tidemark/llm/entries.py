"""The corpus queries by name, each over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from . import licences, middle, vectors
from .common import table
from .decontaminate import contaminated
from .html import extract_pages
from .minhash import near_duplicates
from .packing import pack
from .quality import classify
from .repeats import remove_repeats
from .secrets import scan_secrets
from .sketch import compare_with_edits
from .tokens import count_tokens
from .whitening import whiten


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def queries() -> dict:
    import corpus_pipeline

    def docs(s, d):
        return table(s, d, "documents")

    return {
        "op1_minhash_near_dedup": lambda s, d: near_duplicates(docs(s, d)),
        "op2_token_counts": lambda s, d: count_tokens(docs(s, d), tokenizer("byte_bpe_50k.json")),
        "op3_secret_scans": lambda s, d: scan_secrets(docs(s, d)),
        "op4_benchmark_decontamination": lambda s, d: contaminated(docs(s, d), table(s, d, "benchmark")),
        "op5_document_fingerprints": lambda s, d: compare_with_edits(docs(s, d)),
        "op6_quality_classifier": lambda s, d: classify(docs(s, d), table(s, d, "labels")),
        "op7_substring_dedup": lambda s, d: remove_repeats(docs(s, d)),
        "op8_licence_scans": lambda s, d: licences.scan_licences(docs(s, d)),
        "op9_html_extraction": lambda s, d: extract_pages(table(s, d, "pages")),
        "op10_harmonic_packing": lambda s, d: pack(docs(s, d), tokenizer("word_bpe_49k.json")),
        "op11_fill_in_middle": lambda s, d: middle.middle_digests(docs(s, d)),
        "op12_embedding_whitening": lambda s, d: whiten(table(s, d, "embeddings")),
        "op13_embedding_near_dedup": lambda s, d: vectors.link_vectors(table(s, d, "embeddings")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    import corpus_pipeline

    found = {"op8_licence_scans": licences.ORACLE_SQL, "op11_fill_in_middle": middle.ORACLE_SQL, "op13_embedding_near_dedup": vectors.ORACLE_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
