"""End-to-end jobs composed from operators; importing a module registers its queries."""


def load_all() -> None:
    from . import corpus  # noqa: F401
    try:
        from . import tokens  # noqa: F401
    except ImportError:
        pass
    try:
        from . import runs  # noqa: F401
    except ImportError:
        pass
    try:
        from . import traces  # noqa: F401
    except ImportError:
        pass
    try:
        from . import build  # noqa: F401
    except ImportError:
        pass
    try:
        from . import streams  # noqa: F401
    except ImportError:
        pass
