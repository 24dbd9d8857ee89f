"""Parameter checks that name every bad value at once."""

from __future__ import annotations


def require(**claims: tuple[object, bool, str]) -> None:
    """Each claim is (value, holds, what it has to be); those that don't hold go into one error."""
    bad = [f"{name}={value!r} (wanted: {wanted})" for name, (value, holds, wanted) in claims.items() if not holds]
    if bad:
        raise ValueError("bad parameters: " + "; ".join(bad))
