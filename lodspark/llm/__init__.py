"""Training-data operators: language, quality and toxicity models, near-duplicate joins,
decontamination, chat windows, lattice scoring, media columns, mixing and token files.

Nothing outside this subpackage imports it.
"""
