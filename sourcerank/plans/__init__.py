"""Named queries over the test tables, with their SQL twins."""

from importlib import import_module

MODULES = ["retrieval", "corpus", "assembly", "evaluation", "run_analytics", "vector", "flows", "generators"]


def load_all() -> None:
    """Import every plan module once, which registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
