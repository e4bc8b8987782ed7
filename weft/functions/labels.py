"""Decision tables as expressions. The values are fixed by the behaviour they reproduce."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROLES = ("user", "assistant", "system", "tool")
STANCES = ("agree", "disagree", "neutral", "question")

# Local model aliases with name and dimension.
MODELS = {
    "minilm6": ("sentence-transformers/all-MiniLM-L6-v2", 384),
    "minilm12": ("sentence-transformers/all-MiniLM-L12-v2", 384),
    "bgesmall": ("BAAI/bge-small-en-v1.5", 384),
    "bgelarge": ("BAAI/bge-large-en-v1.5", 1024),
    "nomicv1": ("nomic-ai/nomic-embed-text-v1", 768),
    "nomicv15": ("nomic-ai/nomic-embed-text-v1.5", 768),
}
_OTHER_NAMES = {
    "allminilml6v2": "minilm6", "all-minilm-l6-v2": "minilm6", "allminilml12v2": "minilm12", "all-minilm-l12-v2": "minilm12", "bgesmallen": "bgesmall",
    "bge-small-en-v1.5": "bgesmall", "bgelargeen": "bgelarge", "bge-large-en-v1.5": "bgelarge", "nomic-embed-text-v1": "nomicv1",
    "nomic-embed-text-v1.5": "nomicv15", "nomic": "nomicv15",
}


def local_model(name: str | None) -> tuple[str, int]:
    """Full name and dimension of a local model; the default for unknown names."""
    key = (name or "").lower()
    return MODELS.get(_OTHER_NAMES.get(key, key), MODELS["minilm6"])


def ollama_dimension(model: Column) -> Column:
    """Dimension by what the model's name contains, 1024 if nothing is known."""
    out = F
    for part, dim in (("bge-m3", 1024), ("bge-large", 1024), ("nomic", 768), ("mxbai", 1024), ("minilm", 384), ("snowflake", 1024)):
        out = out.when(F.contains(model, F.lit(part)), dim)
    return out.otherwise(1024)


def recommend_model(size: Column, use_case: Column) -> Column:
    """The embedding model for a corpus of ``size`` documents and a use case; first rule wins."""
    small, middle, large = "all-MiniLM-L6-v2 (default)", "nomic-embed-text-v1.5", "bge-large-en-v1.5"
    return (
        F.when(size < 1000, small)
        .when((size > 10000) & (use_case == "production"), middle)
        .when(use_case.isin("legal", "compliance"), large)
        .when(use_case.isin("code", "code-search"), small)
        .when(size <= 10000, middle)
        .otherwise(small)
    )


def hardware_rating(single_ms: Column, batch_100_ms: Column) -> Column:
    rate = F.lit(100.0) / batch_100_ms * 1000
    return (
        F.when((single_ms < 2) & (rate > 1000), "Excellent")
        .when((single_ms < 5) & (rate > 500), "Good")
        .when((single_ms < 10) & (rate > 200), "Fair")
        .otherwise("Needs Optimization")
    )


def corpus_status(spans: Column) -> Column:
    return F.when(spans < 10, "small").when(spans < 1000, "optimal").when(spans < 10000, "large").otherwise("very large")


def utilisation(used: Column, budget: Column) -> Column:
    """Percent of the budget in use, cut to an integer; 0 for no budget."""
    return F.when(budget > 0, F.floor(used * 100 / budget)).otherwise(0).cast("long")


def valid_role(role: Column) -> Column:
    return F.coalesce(role.isin(*ROLES), F.lit(False))


def valid_stance(stance: Column) -> Column:
    return F.coalesce(F.lower(stance).isin(*STANCES), F.lit(False))
