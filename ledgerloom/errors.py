"""What a request or a check can fail with."""


class LedgerError(Exception):
    """Base of all errors of this library."""


class OutOfRange(LedgerError):
    """A height lies above the tip."""


class Unavailable(LedgerError):
    """The head is not ready or not fresh, or the log is empty."""


class InvalidArgument(LedgerError):
    """A request that no state of the log could answer."""


class NotFound(LedgerError):
    """No such block or transaction."""


class ResourceExhausted(LedgerError):
    """A request beyond a fixed limit."""


class IntegrityError(LedgerError):
    """A check that stored or offered data failed, and the height at which it did."""

    def __init__(self, check: str, height: int | None = None, detail: str = ""):
        super().__init__(f"{check}" + (f" at height {height}" if height is not None else "") + (f": {detail}" if detail else ""))
        self.check, self.height = check, height
