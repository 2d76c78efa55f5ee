"""Part of the phaselens engine."""
