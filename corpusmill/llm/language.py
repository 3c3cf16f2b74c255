"""Language posteriors from character n-grams: a naive Bayes model over hashed n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "fr", "de", "es", "it", "pt", "zh")
BITS = 15
#: Bound of the labelled sample: so many documents a language, of at most so many characters.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 250, 20_000
#: Texts scored at once; bounds the memory of the n-gram arrays.
CHUNK = 400

# Frequent words of each language. They stand in for languages that a small corpus
# has no labelled documents of.
FREQUENT_WORDS = {
    "en": "the of and to in is that it was for on are with as they be at one have this from by but what all were when we "
    "there can an your which their if will each about how up out them then she many some so these would other into has",
    "fr": "le la les de des du un une et est que qui dans pour sur pas ne plus avec ce cette il elle on nous vous mais ou "
    "si leur y en au aux par sont être fait comme tout bien même très aussi où quand parce encore peut votre merci",
    "de": "der die das und ist nicht ein eine einen dem den des mit auf für von zu im sich auch als an es wenn man noch nur "
    "aber oder wie wir ihr sie bei nach über aus durch weil schon sehr kann soll werden wird hat haben sollte können",
    "es": "el la los las de del un una y es que en no se por con para su al lo como más pero sus le ya o este sí porque esta "
    "entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra",
    "it": "il lo la i gli le di del della un una e è che in non si per con su al come più ma o questo perché questa tra "
    "quando molto senza anche fino dove chi da tutto ci durante tutti uno né contro sono essere ha hanno può ancora",
    "pt": "o a os as de do da um uma e é que em não se por com para seu ao como mais mas ou este porque esta entre quando "
    "muito sem sobre também até há onde quem desde tudo nos durante todos uns lhes nem contra são ser tem pode ainda",
    "zh": "的一是不了，在人有我他这个们中来上大为和国地。到以说时要就出会可也你对生能而子，那得于着下自之年。",
}


def gram_codes(text: str) -> np.ndarray:
    """Two rows: hashed buckets of the pairs and of the triples of characters that end at each place."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # characters of Han script stand for their script
    c = np.where((c >= 0x3400) & (c <= 0x9FFF), np.uint64(0x4E00), c)
    if len(c) < 3:
        c = np.concatenate([np.full(3 - len(c), 32, np.uint64), c])
    pairs = c[1:-1] * np.uint64(0x9E3779B1) + c[2:] * np.uint64(0x85EBCA77)
    triples = pairs + c[:-2] * np.uint64(0xC2B2AE3D)
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(11)
    top = np.uint64(1 << BITS)
    return np.stack([(pairs ^ (pairs >> shift)) & mask, ((triples ^ (triples >> shift)) & mask) + top])


class LanguageModel:
    """log P(n-gram | language) for hashed pairs and triples."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights  # (2 << BITS, languages) float32

    @staticmethod
    def fit(texts: list[str], labels: list[str]) -> LanguageModel:
        """Two rounds: documents that the first round puts into another language are left out of the
        second, since labels may be wrong."""
        kept = list(zip(texts, labels))
        model = None
        for _ in range(2):
            counts = np.full((2 << BITS, len(LANGUAGES)), 0.02)
            for k, lang in enumerate(LANGUAGES):
                own = [(" " + FREQUENT_WORDS[lang] + " ").lower()] * 2 + [t.lower() for t, x in kept if x == lang]
                codes = np.concatenate([gram_codes(t).ravel() for t in own]).astype(np.int64)
                # weigh languages alike, however many documents each has
                counts[:, k] += np.bincount(codes, minlength=2 << BITS) * (50_000 / len(codes))
            half = 1 << BITS
            share = np.concatenate([counts[:half] / counts[:half].sum(0), counts[half:] / counts[half:].sum(0)])
            logs = np.log(share)
            model = LanguageModel((logs - logs.mean(1, keepdims=True)).astype(np.float32))
            if kept:
                found = model.score([t for t, _ in kept]).argmax(1)
                kept = [(t, x) for (t, x), k in zip(kept, found) if LANGUAGES[k] == x]
        return model

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Log posteriors up to a constant, one row a text; zeros for null and very short ones."""
        out = np.zeros((len(texts), len(LANGUAGES)), np.float32)
        for start in range(0, len(texts), CHUNK):
            part = [(t or "").lower() for t in texts[start : start + CHUNK]]
            joined = "\n\n".join(part) + "\n\n "
            ends = np.cumsum([len(t) + 2 for t in part])
            codes = gram_codes(joined)
            n = codes.shape[1]
            each = self.weights[codes[0]] + self.weights[codes[1]]
            starts = np.minimum(np.concatenate([[0], ends[:-1]]), n - 1)
            out[start : start + len(part)] = np.add.reduceat(each, starts, axis=0)
        # the separators and the two places across borders count alike for all languages, nearly
        return out


def fit_language_model(documents: DataFrame) -> LanguageModel:
    """Fit on at most SAMPLE_DOCUMENTS labelled documents a language, chosen by a hash of doc_id.

    The sample's size is bounded whatever the corpus; with no labelled document at all the model
    rests on the frequent words.
    """
    labelled = documents.where(
        F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull() & F.length("text").between(60, SAMPLE_CHARS)
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel.fit([], [])
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(1e6 * SAMPLE_DOCUMENTS / n)) for x, n in counts.items()])
    sample = labelled.where(place < share).select("lang", "text").limit(2 * SAMPLE_DOCUMENTS * len(LANGUAGES)).collect()
    return LanguageModel.fit([r["text"] for r in sample], [r["lang"] for r in sample])
