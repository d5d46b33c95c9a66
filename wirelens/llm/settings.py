"""Production parameters shared by the registered queries and the corpus pipeline."""

import os

MIN_DOCUMENTS = 10
NEAR = {"shingle": 2, "percent": 80}  # the contract of op4
NEAR_STAGE = {"shingle": 5, "percent": 80}  # the pipeline's
LIMITS = {"window": 8, "min_words": 20, "max_window_percent": 30, "min_repeat": 10, "max_repeated_percent": 25, "max_repeat": 200}
WIDTH = 10
PACKING = {"end_id": 2, "most": 4096}


def tokenizer() -> str:
    """The vocabulary file; WIRELENS_TOKENIZER names another."""
    named = os.environ.get("WIRELENS_TOKENIZER")
    if named:
        return named
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def aligned_tokenizers() -> tuple[str, str]:
    """The byte-level and the piece vocabulary; WIRELENS_ALIGNED names two others, with os.pathsep between."""
    named = os.environ.get("WIRELENS_ALIGNED")
    if named:
        first, second = named.split(os.pathsep)
        return first, second
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
