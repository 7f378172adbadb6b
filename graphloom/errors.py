"""Typed errors."""


class GraphloomError(Exception):
    """Base of all errors raised here."""


class NameError_(GraphloomError):
    """A prefixed name or IRI that cannot be parsed."""


class NotFound(GraphloomError):
    """A requested class, record or graph that does not exist."""


class DecodeError(GraphloomError):
    """A record that lacks a required field or holds a value of the wrong type."""


class Conflict(GraphloomError):
    """Another writer has committed the version that this one was to make."""


class QueryError(GraphloomError):
    """A query of the wrong form, or one whose parts do not share variables."""


class MissingContext(GraphloomError):
    """A participant without the metadata a step needs."""


class ModelMismatch(GraphloomError):
    """Model weights with different layers or lengths."""


class NotEnough(GraphloomError):
    """Fewer participants or weights than a step asks for."""

    def __init__(self, what: str, got: int, wanted: int) -> None:
        super().__init__(f"not enough {what}: got {got}, wanted {wanted}")
        self.what, self.got, self.wanted = what, got, wanted
