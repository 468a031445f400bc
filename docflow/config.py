"""Parameters shared by the operators.

Every default below is a fixed value of the method; results depend on them.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # document typing
    max_features: int = 1000
    max_clusters: int = 10
    restarts: int = 10
    similarity_threshold: float = 0.8
    # correlators
    key_frequency: float = 0.8
    corroboration: float = 0.5
    primary_coverage: float = 0.5
    secondary_coverage: float = 0.3
    value_overlap: float = 0.3
    # relations
    same_value_threshold: float = 0.8
    same_common_value_threshold: float = 1.0
    significant_instance_threshold: float = 0.9
    rule_significance_threshold: float = 0.9
    # activities
    direction_cut: float = 0.2
    unclear_shift: float = 0.15
    unclear_cut: float = 0.1
    early_bonus: float = 1.5
    late_penalty: float = 0.5
    reference_weight: float = 2.0
    position_factor: float = 2.0
    sequence_weight: float = 1.5
    attribute_weight: float = 1.2
    temporal_weight: float = 2.0
    variant_weight: float = 0.5
    parallel_penalty: float = 6.0
    parallel_factor: float = 3.0
    loop_weight: float = -1.0
    min_score: float = 2.0
    main_layer_share: float = 0.8
    # merging
    case_overlap: float = 0.8
    partial_overlap: float = 0.9
    document_overlap: float = 0.8
    identical_overlap: float = 0.7
    # numeric relations
    tolerance: float = 0.01
    max_terms: int = 3
    strong_correlation: float = 0.9
    exact_correlation: float = 0.99
    # decisions
    tree_depth: int = 4
    tree_min_rows: int = 5
    min_importance: float = 0.01
    # business patterns
    max_pattern_days: int = 30


DEFAULTS = Params()
