"""Vocabulary operators: word counts, rank vocabularies, BPE / WordPiece training.

Training is Spark-side counting on the word table (distinct pre-tokens with
their counts), which is the only corpus-sized input; the vocabulary itself is
bounded by ``vocab_size`` and is the only thing the driver holds.

BPE and WordPiece merges are learned exactly, many a round, by
:mod:`tessera.operators.merges`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.text import normalize, pretokenize
from .lookup import is_cut
from .merges import MAX_SYMBOLS, Vocabulary, learn_merges
from .order import with_pos, written
from .unigram import LONGEST, learn_pieces

# --- fixed values: EOS names looked up at pretokenize time, in priority order --
EOS_CANDIDATES = ("<|endoftext|>", "</s>", "<eos>", "[EOS]")
WORDPIECE_PREFIX = "##"


def word_counts(docs: DataFrame, text_col: str = "text", pre_tokenizer: str = "whitespace",
                normalizer: str | None = None) -> DataFrame:
    """``(word, count)`` over the corpus: explode pre-tokens, partial + final count.  Of documents that
    ``encode.token_blocks`` has cut already, the counts inside the blocks add up."""
    if is_cut(docs):
        each = docs.where("_distinct is not null").select(F.explode(F.arrays_zip("_distinct", "_counts")).alias("x"))
        return each.groupBy(F.col("x._distinct").alias("word")).agg(F.sum("x._counts").alias("count"))
    text = normalize(text_col, normalizer) if normalizer not in (None, "none") else F.col(text_col)
    words = docs.select(F.explode(pretokenize(text, pre_tokenizer)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def rank_vocab(counts: DataFrame, special_tokens: Sequence[str] = ()) -> DataFrame:
    """Word-level vocabulary: special tokens first, then words by (count desc, word)."""
    ranked = with_pos(counts, [F.col("count").desc(), F.col("word")], "id")
    ranked = ranked.select(F.col("word").alias("token"), (F.col("id") + len(special_tokens)).alias("id"))
    if special_tokens:
        spark = counts.sparkSession
        sp = spark.createDataFrame([(t, i) for i, t in enumerate(special_tokens)], "token string, id long")
        ranked = sp.unionByName(ranked)
    return ranked


def vocab_stats(vocab: DataFrame, special_tokens: Sequence[str] = ()) -> DataFrame:
    sp = list(special_tokens)
    return vocab.agg(
        F.count(F.lit(1)).alias("vocab_size"),
        F.count(F.when(F.col("token").isin(sp), 1)).alias("special_tokens"),
        F.max("id").alias("max_id"),
        F.round(F.avg(F.length("token")), 6).alias("avg_token_chars"),
        F.max(F.length("token")).alias("max_token_chars"))


def find_eos(vocab: DataFrame, candidates: Sequence[str] = EOS_CANDIDATES) -> DataFrame:
    """First candidate present in the vocabulary (one row, null when none)."""
    prio = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("token"))
    return (vocab.where(F.col("token").isin(list(candidates)))
            .agg(F.min_by("id", prio).alias("eos_id"), F.min_by("token", prio).alias("eos_token")))


def token_dtype(vocab_size: int) -> str:
    return "uint16" if vocab_size < 2 ** 16 else "uint32"



# The options as parts of the public library's tokenizer file.
_NORMALIZER_PARTS: dict[str, dict | None] = {
    "none": None, "nfc": {"type": "NFC"}, "nfd": {"type": "NFD"}, "nfkc": {"type": "NFKC"}, "nfkd": {"type": "NFKD"},
    "lowercase": {"type": "Lowercase"},
    "nfc_lowercase": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]},
}
_PRE_TOKENIZER_PARTS: dict[str, dict | None] = {
    "whitespace": {"type": "Whitespace"},
    "byte_level": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
    "digits": {"type": "Digits", "individual_digits": False},
    "whitespace_digits": {"type": "Sequence", "pretokenizers": [{"type": "Whitespace"},
                                                                {"type": "Digits", "individual_digits": True}]},
}


def _option(part: dict | None, known: dict[str, dict | None], absent: str) -> str:
    if part is None:
        return absent
    for name, p in known.items():
        if p is not None and all(part.get(k) == v for k, v in p.items()):
            return name
    raise ConfigError(f"unsupported part of a tokenizer file: {part}")


# --- subword training ------------------------------------------------------------------
@dataclass
class SubwordModel:
    """A trained vocabulary: ``tokens[id]`` and merges in rank order."""

    kind: str
    tokens: list[str]
    merges: list[tuple[int, int]] = field(default_factory=list)
    special_tokens: list[str] = field(default_factory=list)
    prefix: str = ""
    scores: list[float] = field(default_factory=list)  # unigram log-probabilities
    max_piece_len: int = 16
    # what training did to a text before counting words, and what encoding therefore does too
    normalizer: str = "none"
    pre_tokenizer: str = "whitespace"
    unk_token: str | None = None

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.tokens, range(len(self.tokens)))), "token string, id long")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, self.tokens[a], self.tokens[b]) for r, (a, b) in enumerate(self.merges)],
                                     "rank long, left string, right string")

    @classmethod
    def from_json(cls, art: dict) -> "SubwordModel":
        """Load an artefact in the public library's layout, with merges as pairs or
        as "left right" strings."""
        m = art["model"]
        common = {"special_tokens": [a["content"] for a in sorted(art.get("added_tokens", []), key=lambda a: a["id"])],
                  "normalizer": _option(art.get("normalizer"), _NORMALIZER_PARTS, "none"),
                  "pre_tokenizer": _option(art.get("pre_tokenizer"), _PRE_TOKENIZER_PARTS, "whitespace")}
        if m["type"] == "Unigram":
            return cls("unigram", [t for t, _ in m["vocab"]], scores=[float(x) for _, x in m["vocab"]],
                       max_piece_len=max((len(t) for t, _ in m["vocab"]), default=1), **common)
        tokens = [t for t, _ in sorted(m["vocab"].items(), key=lambda kv: kv[1])]
        for t in common["special_tokens"]:  # added tokens may stand beside the model's vocabulary
            if t not in m["vocab"]:
                tokens.append(t)
        ids = {t: i for i, t in enumerate(tokens)}
        pairs = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in m.get("merges", [])]
        return cls("bpe" if m["type"] == "BPE" else "wordpiece", tokens, [(ids[a], ids[b]) for a, b in pairs],
                   prefix=m.get("continuing_subword_prefix") or "", unk_token=m.get("unk_token"), **common)

    def save(self, spark: SparkSession, path: str, training_config: dict | None = None) -> None:
        """Vocabulary (+ merges) as Parquet, the JSON artefact and training metadata as one-row JSON."""
        import json
        self.vocab_df(spark).write.mode("overwrite").parquet(f"{path}/vocab")
        if self.merges:
            self.merges_df(spark).write.mode("overwrite").parquet(f"{path}/merges")
        meta = {"tokenizer_type": self.kind, "vocab_size": len(self.tokens),
                "special_tokens": len(self.special_tokens), "merges": len(self.merges),
                "artefact": json.dumps(self.to_json(), ensure_ascii=False),
                "training_config": json.dumps(training_config or {}, ensure_ascii=False)}
        spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SubwordModel":
        import json
        row = spark.read.json(f"{path}/metadata").select("artefact").first()
        return cls.from_json(json.loads(row["artefact"]))

    def to_json(self) -> dict:
        """Artefact in the public tokenizer-library JSON layout (model part)."""
        vocab = {t: i for i, t in enumerate(self.tokens)}
        added = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False,
                  "normalized": False, "special": True} for i, t in enumerate(self.special_tokens)]
        around = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added,
                  "normalizer": _NORMALIZER_PARTS[self.normalizer], "post_processor": None, "decoder": None,
                  "pre_tokenizer": _PRE_TOKENIZER_PARTS[self.pre_tokenizer]}
        if self.kind == "unigram":
            return around | {"model": {"type": "Unigram", "unk_id": None, "byte_fallback": False,
                                       "vocab": [[t, s] for t, s in zip(self.tokens, self.scores)]}}
        model = {"type": "BPE" if self.kind == "bpe" else "WordPiece", "vocab": vocab}
        if self.kind == "bpe":
            model.update({"dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                          "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False,
                          "ignore_merges": False,
                          "merges": [[self.tokens[a], self.tokens[b]] for a, b in self.merges]})
        else:
            model.update({"unk_token": self.unk_token or "[UNK]", "continuing_subword_prefix": self.prefix,
                          "max_input_chars_per_word": 100})
        return around | {"model": model}


def train_subword(counts: DataFrame, vocab_size: int, min_frequency: int = 0,
                  special_tokens: Sequence[str] = (), kind: str = "bpe", normalizer: str = "none",
                  pre_tokenizer: str = "whitespace", log: list[dict] | None = None) -> SubwordModel:
    """Train BPE (``kind='bpe'``) or a WordPiece vocabulary by BPE-style merges
    with the ``##`` continuation prefix (``kind='wordpiece'``; every character
    also stands without the prefix, and those that continue words follow in
    code point order).  ``normalizer`` and ``pre_tokenizer`` are those that
    ``counts`` were made with; the model keeps them for encoding.  The merges
    are those of the sequential rule, see :mod:`tessera.operators.merges`,
    whose rounds ``log`` lists.
    """
    if kind not in ("bpe", "wordpiece"):
        raise ConfigError(f"Unknown trainer {kind!r}")
    if vocab_size > MAX_SYMBOLS:
        raise ConfigError(f"vocab_size above {MAX_SYMBOLS}")
    prefix = WORDPIECE_PREFIX if kind == "wordpiece" else ""
    counts = written(counts.select("word", F.col("count").cast("long").alias("count")), "word-counts")
    # the alphabet is bounded by the number of distinct characters
    chars = F.transform(F.split("word", ""), lambda ch, i: F.struct(ch.alias("ch"), (i > 0).alias("later")))
    seen = counts.select(F.explode(chars).alias("x")).select("x.ch", "x.later").distinct().where("ch != ''").collect()
    alphabet = sorted({r["ch"] for r in seen}, key=ord)
    if prefix:
        alphabet += [prefix + c for c in sorted({r["ch"] for r in seen if r["later"]}, key=ord)]
    vocab = Vocabulary([*special_tokens, *(t for t in alphabet if t not in special_tokens)], prefix)
    learn_merges(counts, vocab, vocab_size, max(1, min_frequency), log=log)
    unknown = "[UNK]" if prefix and "[UNK]" in special_tokens else None
    return SubwordModel(kind=kind, tokens=vocab.tokens, merges=vocab.merges, special_tokens=list(special_tokens),
                        prefix=prefix, normalizer=normalizer, pre_tokenizer=pre_tokenizer, unk_token=unknown)


# --- unigram ---------------------------------------------------------------------------
def _viterbi(word: str, logp: dict, max_len: int):
    """Best segmentation of ``word`` under piece log-probabilities (None if impossible)."""
    n = len(word)
    best = [float("-inf")] * (n + 1)
    back = [0] * (n + 1)
    best[0] = 0.0
    for end in range(1, n + 1):
        for start in range(max(0, end - max_len), end):
            lp = logp.get(word[start:end])
            if lp is not None and best[start] + lp > best[end]:
                best[end] = best[start] + lp
                back[end] = start
    if best[n] == float("-inf"):
        return None, best[n]
    pieces, end = [], n
    while end > 0:
        pieces.append(word[back[end]:end])
        end = back[end]
    return pieces[::-1], best[n]


def train_unigram(counts: DataFrame, vocab_size: int, special_tokens: Sequence[str] = (),
                  max_piece_len: int = LONGEST, em_rounds: int = 2, shrink: float = 0.75, normalizer: str = "none",
                  pre_tokenizer: str = "whitespace", log: list[dict] | None = None) -> SubwordModel:
    """Unigram vocabulary by EM over lattices and pruning by loss, see :mod:`tessera.operators.unigram`.
    The min_frequency argument of the other trainers does not apply here."""
    found = learn_pieces(counts, int(vocab_size) - len(special_tokens), int(max_piece_len), em_rounds, shrink, log)
    found = [(p, s) for p, s in found if p not in special_tokens]
    return SubwordModel(kind="unigram", tokens=[*special_tokens, *(p for p, _ in found)], special_tokens=list(special_tokens),
                        scores=[0.0] * len(special_tokens) + [s for _, s in found],
                        max_piece_len=max((len(p) for p, _ in found), default=1), normalizer=normalizer,
                        pre_tokenizer=pre_tokenizer)
