"""The registered queries, by subject."""

from veritab.plans import audit, explanations, metrics, networks, panels, perturbations, relational, similarity, sweeps, verdicts

ALL = (similarity, relational, metrics, explanations, networks, panels, perturbations, verdicts, sweeps, audit)
