"""Settings, coerced and checked up front: every problem of a configuration is reported in one error."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

# Words for booleans, and below the names and defaults of the settings.
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off", ""}


def as_bool(value: object, name: str) -> bool:
    text = str(value).strip().lower() if value is not None else ""
    if text not in TRUE | FALSE:
        raise ValueError(f"{name} must be a boolean, not {value!r}")
    return text in TRUE


def as_number(value: object, name: str, kind: type = float) -> float | int:
    try:
        return kind(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be of type {kind.__name__}, not {value!r}") from None


def as_positive(value: object, name: str) -> int:
    if isinstance(value, bool) or (number := as_number(value, name, int)) < 1:
        raise ValueError(f"{name} must be a positive integer, not {value!r}")
    return number


def score_suffix(column: str) -> str:
    """The part of a score column that names its kind."""
    return "".join(c if c.isalnum() else "_" for c in column.removeprefix("score_"))


@dataclass
class CallSettings:
    """From reads to the call matrix."""

    output_dir: str = ""
    percentage: float | None = None
    data_type: str = "sc"
    count_unit: str = "reads"
    p_alt_if_variant: float = 0.5
    alt_error_rate: float = 0.001
    default_prior: float = 0.001
    prior_scale: float = 2.0
    prior_cap: float = 0.95
    estimate_p_per_sample: bool = False
    p_estimation_min_alt_count: int = 2
    p_estimation_min_total_count: int = 2
    p_estimation_min_observations: int = 25
    p_estimation_min_snvs: int = 5
    pileup_base_quality_min: int = 20
    pileup_mapping_quality_min: int = 20
    neg1_prob_hist_bins: int = 60
    neg1_prob_threshold: float | None = None
    af_filter_enabled: bool = False
    af_field: str = "gnomad41_genome_AF"
    af_max: float = 0.001
    af_strict_snv_format: bool = False
    samples: dict = field(default_factory=dict)

    @classmethod
    def of(cls, given: dict) -> CallSettings:
        settings, samples = given.get("settings", given), given.get("samples", {})
        errors, values = [], {"samples": samples}
        for f in fields(cls):
            if f.name not in settings or f.name == "samples":
                continue
            value = settings[f.name]
            try:
                if "None" in str(f.type) and (value is None or str(value).strip().lower() in ("", "none")):
                    value = None
                elif f.type == "bool":
                    value = as_bool(value, f.name)
                elif f.type == "int":
                    value = as_number(value, f.name, int)
                elif "float" in str(f.type):
                    value = as_number(value, f.name)
                values[f.name] = value
            except ValueError as e:
                errors.append(str(e))
        out = cls(**values)
        errors += out.problems()
        if errors:
            raise ValueError("the configuration has errors: " + "; ".join(errors))
        return out

    def problems(self) -> list[str]:
        out = [] if self.output_dir else ["output_dir is missing"]
        if self.data_type not in ("sc", "spatial"):
            out.append("data_type must be sc or spatial")
        if self.count_unit not in ("reads", "umis"):
            out.append("count_unit must be reads or umis")
        out += [f"{n} must lie between 0 and 1" for n in ("p_alt_if_variant", "alt_error_rate", "default_prior", "prior_cap") if not 0 < getattr(self, n) < 1]
        if self.prior_scale <= 0:
            out.append("prior_scale must be positive")
        if self.neg1_prob_threshold is not None and not 0 <= self.neg1_prob_threshold <= 1:
            out.append("neg1_prob_threshold must lie between 0 and 1")
        if self.af_max < 0:
            out.append("af_max must not be negative")
        out += [f"{n} must be at least 1" for n in ("p_estimation_min_alt_count", "p_estimation_min_total_count", "p_estimation_min_observations", "p_estimation_min_snvs") if getattr(self, n) < 1]
        needed = ["bam", "vcf", "cb"] + ["annotated_vcf"] * self.af_filter_enabled
        out += [f"samples.{s}.{k} is missing" for s, paths in self.samples.items() for k in needed if not str((paths or {}).get(k) or "").strip()]
        return out

    def digest(self) -> str:
        """Changes with any setting: stages written under it are not taken for those of other settings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def load(path: str) -> dict:
    """A YAML file where PyYAML is installed, else JSON."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(content)
    return yaml.safe_load(content)


def picked(config: dict, section: str, key: str, default=None):
    """The value in the section, else at the root, else the default."""
    return (config.get(section) or {}).get(key, config.get(key, default))


TEMPLATE = {
    "settings": {"output_dir": "out", "percentage": 10, "data_type": "sc", "count_unit": "reads", "neg1_prob_threshold": None, "af_filter_enabled": False},
    "samples": {"S1": {"bam": "S1.sam", "vcf": "S1.vcf", "cb": "S1.barcodes.csv"}},
    "scoring": {"min_cnt": 50, "top_k_attention": 2000, "min_carrier_cells": 20, "min_shared_cells": 20, "jaccard": 0.85, "overlap": 0.95},
}
