"""Where the vocabulary files of public tokenizers are; every operator takes such a path as an argument."""

import public_tokenizers

#: Byte-level BPE with word ends, for ``tokenizers``.
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: BPE with byte fallback, for ``sentencepiece``.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
