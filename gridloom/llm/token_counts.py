"""Token counts: Arrow batches encoded by the tokenizer's own library, lengths only.

Batches for the encoder hold about the same number of bytes, and long texts are
cut at places where the cut cannot change the tokens, so one huge text neither
fills memory nor delays its batch.
"""

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A cut is safe between a letter or digit and one space that a letter or digit follows: byte-level
#: and word pre-tokenizers end a piece there whatever stands around, and no special token has a space.
SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: Further safe places, for texts that have few of those: also where ASCII letters and digits meet, and before
#: ideographic punctuation that follows a letter.
FINE = re.compile(r"(?<=[^\W_])(?= [^\W_]|[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


#: Pre-tokenizers that begin a piece at a single space between letters or digits, so that cuts there change nothing.
CUTTABLE = ("ByteLevel", "Whitespace", "WhitespaceSplit", "BertPreTokenizer", "Split")
#: A segment longer than this is not remembered.
SEGMENT_CHARS = 64


PROBE = "abc123def 4g、h。い the quick brown Fox's 12 tails 3 é ß 4th über naïve 日本 語 x y z a1 2b don't we'll it  is a\nnew line I am"


def cuts_are_safe(config: dict) -> bool:
    """Whether the vocabulary's pre-tokenizer is known to part a text at a single space between letters or digits.

    No added token may have such a place. Patterns (Split) and normalizers are tried: a text and its
    parts must give equal tokens. See load.
    """
    if any(FINE.search(t["content"]) for t in config.get("added_tokens", ())):
        return False
    found = config.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in found.get("pretokenizers", [found])]
    return any(k in CUTTABLE for k in kinds)


def load(vocabulary: str):
    """(encode many texts to lengths, may texts be cut). Bare names are files of public_tokenizers.

    Texts are cut only for a known kind of pre-tokenizer, and where a probe gives the same tokens cut and whole.
    """
    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    model.no_truncation()
    model.no_padding()
    tokens = lambda text: model.encode(text, add_special_tokens=False).ids
    with open(vocabulary, encoding="utf-8") as file:
        may_cut = cuts_are_safe(json.load(file)) and tokens(PROBE) == [i for part in FINE.split(PROBE) for i in tokens(part)]
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], may_cut


def pieces(text: str, size: int) -> Iterator[str]:
    """Cut text at safe places into pieces of at least `size` characters; whole if there is none."""
    start = 0
    while len(text) - start > size:
        cut = FINE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def memoized(encode, most: int = 1 << 19):
    """Count pieces through a table of what their safe segments took before; exact, as cuts there change nothing.

    Only segments not yet in the table are encoded, all of a batch in one call. Segments above
    SEGMENT_CHARS are not kept, and the table is emptied when it exceeds `most` entries, so it holds
    about 60 MB of words, and 200 MB of the longest segments, whatever the texts.
    """
    known: dict[str, int] = {}

    def count(batch: list[str]) -> list[int]:
        if len(known) > most:
            known.clear()
        rows = []
        for piece in batch:
            first, *rest = SAFE.split(piece)
            row = [first, *[" " + r for r in rest]]
            rows.append([t for s in row for t in (FINE.split(s) if len(s) > SEGMENT_CHARS else (s,))])
        new = list({s: None for row in rows for s in row if s not in known})
        here = dict(zip(new, encode(new), strict=True))
        known.update(here)
        counts = [sum(map(known.__getitem__, row)) for row in rows]
        for s in [s for s in here if len(s) > SEGMENT_CHARS]:
            del known[s]
        return counts

    return count


def lengths(texts: list, encode, may_cut: bool, batch_bytes: int, piece_chars: int) -> list[int]:
    """Tokens of each text; None counts as empty."""
    out, batch, owners, held = [0] * len(texts), [], [], 0

    def flush():
        for owner, n in zip(owners, encode(batch), strict=True):
            out[owner] += n
        batch.clear()
        owners.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        for piece in pieces(text, piece_chars) if may_cut else (text,):
            batch.append(piece)
            owners.append(i)
            held += len(piece.encode())
            if held >= batch_bytes:
                flush()
                held = 0
    if batch:
        flush()
    return out


def token_length(text: Column, vocabulary: str = "byte_bpe_50k.json", batch_bytes: int = 1 << 19, piece_chars: int = 1 << 15) -> Column:
    """Number of tokens of a text column as a long, without added special tokens, truncation or padding."""

    @F.arrow_udf(LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, may_cut = load(vocabulary)
        if may_cut:
            encode = memoized(encode)
        for texts in batches:
            yield pa.array(lengths(texts.to_pylist(), encode, may_cut, batch_bytes, piece_chars), pa.int64())

    return count(text)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens; null ids stay null; repeated rows
    are counted each; other columns are not read. An empty table gives no rows.
    """
    counted = df.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), token_length(F.col(text_col), vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
