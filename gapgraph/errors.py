"""Errors of the engine."""


class GapGraphError(Exception):
    """Base of all errors raised on purpose."""


class CorpusError(GapGraphError):
    """A corpus cannot be read: nothing there, no text files, or all of them empty."""

    def __init__(self, path: str, reason: str):
        super().__init__(f"cannot load {path}: {reason}")
        self.path, self.reason = path, reason


class CompletionError(GapGraphError):
    """A language-model client failed on every attempt."""

    def __init__(self, model: str, reason: str, attempts: int = 1):
        super().__init__(f"{model}: {reason} (after {attempts} attempts)")
        self.model, self.reason, self.attempts = model, reason, attempts


class ExtractionError(GapGraphError):
    """An answer held no usable JSON, even after the strict retry."""

    def __init__(self, source: str, reason: str):
        super().__init__(f"{source}: {reason}")
        self.source, self.reason = source, reason


class NoGapsError(GapGraphError):
    """Hypotheses were asked for on a graph without gaps."""
