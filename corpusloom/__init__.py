"""Shape-aware text analytics as DataFrame transformations."""

_HOMES = {"LEVELS": "plans.levels", "compress": "plans.router", "contract_json": "plans.router", "register": "functions.register"}
__all__ = list(_HOMES)


def __getattr__(name: str):
    """Names of the surface, loaded when asked for: workers import single modules."""
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
