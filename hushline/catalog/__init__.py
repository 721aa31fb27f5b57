"""Query catalogue: one module per part of the inventory."""

from importlib import import_module

MODULES = ("tables", "scores", "policy", "spectra", "safe_reference", "models", "stream", "audio")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
