"""The engine's errors."""


class EngineError(Exception):
    """Base of all errors the engine raises on purpose."""


class UnknownRepo(EngineError):
    """A row's repository has no split."""


class SplitConflict(EngineError):
    """A repository lies in two splits."""


class GateFailure(EngineError):
    """An audit gate failed."""

    def __init__(self, failures: list[tuple[str, str]]):
        self.failures = failures
        self.repos = sorted({repo for repo, _ in failures})
        super().__init__("; ".join(f"{repo}: {gate}" for repo, gate in failures))


class HashMismatch(EngineError):
    """An artifact was built from other inputs."""


class InvalidRecord(EngineError):
    """A record breaks its schema."""


class PreflightFailure(EngineError):
    """A check before a run failed."""

    def __init__(self, failed: list[str]):
        self.failed = failed
        super().__init__("preflight failed: " + ", ".join(failed))
