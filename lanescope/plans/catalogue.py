"""Every registered query and its SQL."""

from __future__ import annotations

from . import review, rules, scenes, tracks

QUERIES: dict = tracks.QUERIES | rules.QUERIES | review.QUERIES | scenes.QUERIES
ORACLES: dict = tracks.ORACLES | rules.ORACLES | review.ORACLES | scenes.ORACLES
