from polyview.operators.matrix import *  # noqa: F401,F403
from polyview.operators.scoring import *  # noqa: F401,F403
