"""The shared storage of the package, under the name by which the operators know it."""

from ..scratch import CLEANUP, Scratch, checkpointed, shared_dir

__all__ = ["CLEANUP", "Scratch", "checkpointed", "shared_dir"]
