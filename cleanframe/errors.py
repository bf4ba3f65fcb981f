"""Errors raised while a plan is being built, before any Spark job runs."""


class SpecError(ValueError):
    """A cleaning operation, rule or comparison was described wrongly."""


def require_columns(df, names):
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SpecError(f"columns not found: {missing}; available: {df.columns}")


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


#: What a parameter may be: a test, and how to say it.
KINDS = {
    "text": (lambda v: isinstance(v, str) and v != "", "a text"),
    "names": (lambda v: bool(v) and all(isinstance(x, str) for x in v), "a list of names"),
    "mapping": (lambda v: isinstance(v, dict) and len(v) > 0, "a mapping with entries"),
    "renaming": (lambda v: isinstance(v, dict) and bool(v) and all(isinstance(x, str) for kv in v.items() for x in kv), "a mapping of names to names"),
    "above zero": (lambda v: (_number(v) or 0) > 0, "a number above zero"),
}


def check(operation: str, **parameters) -> None:
    """Refuse parameters that are not what they must be: name=(value, kind), the kind a name
    of KINDS or a collection of the values allowed."""
    for name, (value, kind) in parameters.items():
        test, said = KINDS[kind] if isinstance(kind, str) else (lambda v, kind=kind: v in kind, f"one of {sorted(kind)}")
        if not test(value):
            raise SpecError(f"{operation}: {name} must be {said}, not {value!r}")
