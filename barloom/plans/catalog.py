"""All registered queries by name."""

from barloom.plans.model_queries import MODEL_QUERIES
from barloom.plans.queries import QUERIES


def all_queries() -> dict:
    return {**QUERIES, **MODEL_QUERIES}
