from .columns import combine, linear, names, number, shifted, triangle
from .generators import normal_seed, seed_table, uniform_seed, validation_seed
from .session import ensure_checkpoint_dir, local_table, scratch_path

__all__ = [
    "combine", "linear", "names", "number", "shifted", "triangle",
    "normal_seed", "seed_table", "uniform_seed", "validation_seed",
    "ensure_checkpoint_dir", "local_table", "scratch_path",
]
