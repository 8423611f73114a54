"""Plan building blocks shared by every operator: materialised cuts and size-checked joins."""
from .materialize import checkpoint_dir, delete, materialize, release, scope
from .lookup import MAX_BROADCAST_ROWS, lookup_join

__all__ = ["checkpoint_dir", "delete", "materialize", "release", "scope", "lookup_join", "MAX_BROADCAST_ROWS"]
