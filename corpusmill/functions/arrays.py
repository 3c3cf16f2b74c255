"""Numbers over array columns: Column -> Column, inside the JVM. Null arrays give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with the value computed once a row; inside a lambda it would be computed each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(F.transform(values, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum, so that it doesn't overflow."""
    shifted = let(
        F.array_max(x).cast("double"), lambda top: F.transform(x, lambda v: F.exp((v.cast("double") - top) / temperature))
    )
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def log_sum_exp(x: Column) -> Column:
    return let(
        F.array_max(x).cast("double"),
        lambda top: top + F.log(total(F.transform(x, lambda v: F.exp(v.cast("double") - top)))),
    )


def log_softmax(x: Column) -> Column:
    return let(log_sum_exp(x), lambda norm: F.transform(x, lambda v: v.cast("double") - norm))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label]; label counts from 0."""
    return log_sum_exp(logits) - F.element_at(logits, (label + 1).cast("int")).cast("double")


def entropy(logits: Column) -> Column:
    """Of softmax(logits); p log p is 0 where p is."""
    lp = log_softmax(logits)
    return -total(F.transform(lp, lambda v: F.when(F.exp(v) > 0, F.exp(v) * v).otherwise(0.0)))


def masked_sum(x: Column, mask: Column) -> Column:
    return total(F.zip_with(x, mask, lambda v, m: F.coalesce(v.cast("double") * m, F.lit(0.0))))


def masked_normalise(x: Column, mask: Column, constant: float) -> Column:
    return masked_sum(x, mask) / constant


def masked_mean(x: Column, mask: Column) -> Column:
    """Null where the mask selects nothing."""
    return F.try_divide(masked_sum(x, mask), total(mask))


def sequence_logprob(token_logprobs: Column, prompt: Column, response: Column) -> Column:
    """Sum over a response of `response` tokens after a prompt of `prompt`: the token before each predicts it,
    so the slice starts one place before the response."""
    return total(F.slice(token_logprobs, F.greatest(prompt, F.lit(1)).cast("int"), response.cast("int")))


def loss_by_type(kind: str, logprobs: Column, rewards: Column, advantages: Column, old: Column, clip: float) -> Column:
    """Token losses of one of three kinds; another one raises."""
    if kind == "no_baseline":
        return policy_loss(logprobs, rewards)
    if kind == "reinforce_with_baseline":
        return policy_loss(logprobs, advantages)
    if kind == "grpo_clip":
        return clipped_loss(logprobs, old, advantages, clip, clip)
    raise ValueError(f"unknown loss: {kind}")


def policy_loss(logprobs: Column, advantage: Column) -> Column:
    return F.transform(logprobs, lambda v: -advantage * v)


def clipped_loss(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """-min(r A, clip(r) A) by token, r = exp(new - old); null where a log-probability or the advantage is."""
    def one(a: Column, b: Column) -> Column:
        r = F.exp(a.cast("double") - b)
        loss = -F.least(r * advantage, F.least(F.greatest(r, F.lit(1 - low)), F.lit(1 + high)) * advantage)
        return F.when((r * advantage).isNotNull(), loss)

    return F.zip_with(new, old, one)


def clipped_share(new: Column, old: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """Share of tokens whose ratio is clipped."""
    out = F.zip_with(new, old, lambda a, b: ~F.exp(a.cast("double") - b).between(1 - low, 1 + high))
    return F.try_divide(F.size(F.filter(out, lambda x: x)).cast("double"), F.size(out))


def log_sigmoid(x: Column) -> Column:
    """Stable for large arguments of either sign."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    return -log_sigmoid(beta * ((chosen - rejected) - (ref_chosen - ref_rejected)))


def top_p(probabilities: Column, p: float) -> Column:
    """The probabilities with those beyond mass p set to 0, renormalised; the one that crosses p stays.
    Of equal probabilities the earlier ones come first."""
    def kept(order: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("kept"))
        step = lambda a, x: F.struct(
            (a["mass"] + x["v"]).alias("mass"),
            F.when(a["mass"] < p, F.concat(a["kept"], F.array(-x["i"]))).otherwise(a["kept"]).alias("kept"),
        )
        return F.aggregate(order, start, step)["kept"]

    def one(values: Column) -> Column:
        order = F.reverse(F.array_sort(F.transform(values, lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("i")))))
        cut = let(
            kept(order),
            lambda ks: F.transform(values, lambda v, i: F.when(F.array_contains(ks, i), v.cast("double")).otherwise(0.0)),
        )
        return let(cut, lambda c: let(total(c), lambda t: F.transform(c, lambda v: v / t)))

    return let(probabilities, one)


def draw(probabilities: Column, uniform: Column) -> Column:
    """Index of the first cumulative mass above `uniform`."""
    step = F.aggregate(
        probabilities,
        F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("i"), F.lit(-1).alias("hit")),
        lambda a, v: F.struct(
            (a["mass"] + v).alias("mass"),
            (a["i"] + 1).alias("i"),
            F.when((a["hit"] < 0) & (a["mass"] + v > uniform), a["i"]).otherwise(a["hit"]).alias("hit"),
        ),
    )
    return F.when(step["hit"] < 0, F.size(probabilities) - 1).otherwise(step["hit"])


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def clip_norm(x: Column, limit: float, eps: float = 1e-6) -> Column:
    scale = lambda n: F.when(n > limit, F.lit(limit) / (n + eps)).otherwise(1.0)
    return let(norm(x), lambda n: let(scale(n), lambda s: F.transform(x, lambda v: v.cast("double") * s)))


def rms_norm(x: Column, eps: float = 1e-5) -> Column:
    return let(F.sqrt(dot(x, x) / F.size(x) + eps), lambda s: F.transform(x, lambda v: v.cast("double") / s))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") / (1 + F.exp(-v.cast("double"))))


def swiglu(gate: Column, value: Column) -> Column:
    """silu(gate) times value, place by place."""
    return F.zip_with(silu(gate), value, lambda a, b: a * b)


def attention(query: Column, keys: Column, values: Column, mask: Column | None = None) -> Column:
    """One query over arrays of keys and values: softmax(q k / sqrt d) weighted values; places whose mask is 0
    get a score of -1e9."""
    scores = F.transform(keys, lambda k: dot(query, k) / F.sqrt(F.size(query)))
    if mask is not None:
        scores = F.zip_with(scores, mask, lambda v, m: F.when(m == 0, F.lit(-1e9)).otherwise(v))
    weighted = lambda w: F.zip_with(w, values, lambda a, v: F.transform(v, lambda x: x.cast("double") * a))
    add = lambda rows: F.aggregate(
        rows, F.array().cast("array<double>"), lambda a, v: F.when(F.size(a) == 0, v).otherwise(F.zip_with(a, v, lambda x, y: x + y))
    )
    return let(softmax(scores), lambda w: add(weighted(w)))


def rotate(x: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotary position embedding of one vector: pairs (2i, 2i+1) turned by position / theta^(2i/d)."""
    d = F.size(x)
    angle = lambda i: position.cast("double") / F.pow(F.lit(theta), (i - i % 2).cast("double") / d)
    at = lambda i: F.element_at(x, (i + 1).cast("int")).cast("double")
    return F.transform(
        x,
        lambda v, i: F.when(i % 2 == 0, v * F.cos(angle(i)) - at(F.least(i + 1, d - 1)) * F.sin(angle(i))).otherwise(
            at(F.greatest(i - 1, F.lit(0))) * F.sin(angle(i)) + v * F.cos(angle(i))
        ),
    )


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
