"""What can be wrong with what a caller gives."""


class TallyError(ValueError):
    """Any of these."""


class PeriodError(TallyError):
    """A text that names no period."""


class RuleError(TallyError):
    """A table of rules that cannot be used."""
