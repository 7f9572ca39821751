"""Errors by kind; ``exit_code`` is what a command line would return."""

from __future__ import annotations


class EngineError(Exception):
    exit_code = 1


class UsageError(EngineError):
    exit_code = 2


class NotFound(EngineError):
    exit_code = 3


class InvariantError(EngineError):
    exit_code = 4


class GateError(EngineError):
    exit_code = 5
