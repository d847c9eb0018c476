"""Alert texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftline.functions.expr import text_prefix

# Wording of the alert messages.
DRIFT_ONE_SIDED = "%s / %s / %s의 %s에서 정상 Baseline 대비 지속적인 %s 추세가 감지되었습니다."
DRIFT_TWO_SIDED = "%s / %s / %s의 %s에서 정상 Baseline(최적값) 대비 %s 방향으로 지속적으로 벌어지는 편차가 감지되었습니다."
ENTERED = "%s / %s / %s의 %s에서 위험 Threshold(%.4f)에 진입했습니다."
DRIFT_TO_RISK = "%s / %s / %s의 %s에서 정상 Baseline 대비 %s 방향으로 지속적으로 벌어지는 편차가 감지되었습니다."
OFF_NORMAL = "%s / %s / %s의 %s에서 정상 수준(%.4f)%s 대비 지속적으로 벌어지는 편차가 감지되었습니다."
THEORY = " (이론 기준값 %.4f)"
SPEC_RUN = (
    "%s / %s / %s의 %s이(가) 멘토 실측 스펙(LSL %s ~ USL %s)을 %d샷 연속으로 벗어났습니다"
    "(현재 %.4f). 평소 위반율 %.3f%%로는 우연히 나올 수 없는 수준입니다."
)
OVER_LIMIT = (
    "%s의 %s이(가) 설비 상한(%s)을 넘었습니다(현재 %.4f). "
    "그날 초과 샷이 우연으로 보기 어려운 수준입니다 — 설비 정비 점검 필요. %s."
)
RELATED = "%s 관련 가능성"
RISE, FALL = "상승", "하강"
ABOVE, BELOW = "높은", "낮은"


def number_text(x: float) -> str:
    """A limit as written in the limit table."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def compose(external: Column, spec: Column, typed: Column) -> Column:
    """External limit first, then the specification text, then the text of the type."""
    return text_prefix([external, spec, typed])


def formatted(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)
