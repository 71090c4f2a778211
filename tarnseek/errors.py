"""The one error type users see for wrong input."""


class TarnseekError(ValueError):
    """A table, field, literal, page or token that cannot be used as asked."""
