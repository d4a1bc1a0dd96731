"""The acceptance run over the test tables. Ordered matches and refunds depend on earlier choices, so there is no SQL for it."""

from __future__ import annotations

import uuid

from ledgerloom.operators.acceptance import accept
from ledgerloom.operators.durable import shared_folder
from ledgerloom.operators.stages import Stages
from ledgerloom.plans.registry import Registry
from ledgerloom.plans.store import load

query = Registry()


@query("acceptance_report")
def acceptance_report(spark, d):
    return accept(Stages(spark, f"{shared_folder(spark)}/accepted-{uuid.uuid4().hex}"), load(spark, d, "raws"))["report"].rows
