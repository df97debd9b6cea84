"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard raw-content dictionary of labelled text. A text is normalised to lower-case letters,
cut into pieces short enough for the dictionary to matter, and compressed with every dictionary; all of it counts.
The margin between the best and the second size, relative to the second, is the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_texts

UNKNOWN = "und"
#: Bounds of what is learned: documents of a language, characters of each, bytes of its dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 64, 4000, 110_000
PIECE_BYTES = 2048
#: The least margin with which a language is taken, relative to the second size and so alike for texts of every length.
#: Of 4000 labelled documents of sf0.1 2 in 1000 of at least 100 bytes lie below it, and 9 in 1000 of all; of random letters
#: and of words of languages that were not learned, 50 words or more, over 95 percent do at every length.
MARGIN = 0.04
#: How pieces are compressed: the window reaches over the whole dictionary, and matches are searched for along chains, so
#: that the sizes of short texts differ by what they share with it.
SEARCH = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 5, "min_match": 4}
#: What is no letter, nor a mark that belongs to one, by Unicode's categories.
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Languages:
    """What learn() found: sorted names and their dictionaries (bounded by DICTIONARY_BYTES each)."""

    names: tuple[str, ...]
    contents: tuple[bytes, ...]

    def compressors(self) -> list:
        import zstandard

        out = []
        for content in self.contents:
            parameters = zstandard.ZstdCompressionParameters(**SEARCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            out.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters))
        return out


def normalise(text: str | None) -> bytes:
    """Lower-case letters and single spaces; empty for a text without a letter."""
    kept = _OTHER.sub(" ", (text or "").lower()).strip()
    return kept.encode("utf-8", "surrogatepass") if _LETTER.search(kept) else b""


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Dictionaries from documents with a language whose crc32(id as text) mod 3 is not 1.

    A language's sample is spread over all its documents: in each of SAMPLE_DOCS buckets of hashed ids, the text with
    the least hash of id and text, so that repeated rows count once. Rows without id, text or language teach nothing.
    """
    usable = docs.where(docs[id_col].isNotNull() & docs[text_col].isNotNull() & docs[lang_col].isNotNull() & (F.crc32(docs[id_col].cast("string")) % 3 != 1))
    bucket = F.pmod(F.xxhash64(docs[id_col].cast("string")), F.lit(SAMPLE_DOCS)).alias("bucket")
    keyed = usable.select(docs[lang_col].alias("lang"), bucket, F.xxhash64(docs[id_col].cast("string"), docs[text_col]).alias("h"), docs[text_col].alias("text"))
    least = keyed.groupBy("lang", "bucket").agg(F.min("h").alias("h")).select("lang", "h").collect()
    if not least:
        return Languages((), ())
    wanted = {r.h for r in least}  # SAMPLE_DOCS a language at most
    # rows with the same hash have the same id and text, and are one
    rows = keyed.where(F.col("h").isin(wanted)).select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct().collect()
    names = tuple(sorted({r.lang for r in rows}))
    texts = {n: b" ".join(normalise(r.text) for r in sorted((r for r in rows if r.lang == n), key=lambda r: (r.h, r.text)))[-DICTIONARY_BYTES:] for n in names}
    names = tuple(n for n in names if len(texts[n]) >= 8)  # the library takes no shorter dictionary
    return Languages(names, tuple(texts[n] for n in names))


def sizes(text: bytes, compressors: list) -> list[int]:
    """Bytes of the whole text under each dictionary."""
    pieces = [text[o : o + PIECE_BYTES] for o in range(0, len(text), PIECE_BYTES)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def classify(docs: DataFrame, languages: Languages, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (the id) with lang_pred, score (0 to 1) and rejected, each named after ``prefix``.

    lang_pred is UNKNOWN for a null text, one without a letter, or where nothing was learned; ties go to the first
    name. score is the margin, relative to the second size; a single learned language has 1. rejected: no language, or
    a margin below ``margin``, whatever the text's length. Repeated rows stay; an empty table gives no rows; a kept
    column with the name of a result gives way to it.
    """
    keep = keep or [id_col]
    broadcast = docs.sparkSession.sparkContext.broadcast(languages)

    def make():
        known = broadcast.value
        compressors = known.compressors()

        def run(texts):
            pred, score, rejected = [], [], []
            for text in map(normalise, texts):
                if not text or not compressors:
                    pred.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    continue
                found = np.array(sizes(text, compressors))
                best = int(found.argmin())
                second = np.delete(found, best).min() if len(found) > 1 else None
                share = 1.0 if second is None else float((second - found[best]) / second)
                pred.append(known.names[best]), score.append(share), rejected.append(share < margin)
            return {f"{prefix}lang_pred": pred, f"{prefix}score": score, f"{prefix}rejected": rejected}

        return run

    return map_texts(docs, keep, text_col, make, f"{prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean")
