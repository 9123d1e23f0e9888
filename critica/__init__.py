"""critica: answer-critique analytics as Spark DataFrame operators.

Sub-packages
------------
functions  native ``Column`` builders (text metrics, critic JSON parsing, HTML cleaning, prompts)
operators  ``DataFrame -> DataFrame`` operators (metrics, critic, trajectories, benchmark, evidence, training)
sources    readers / writers and the driver-table loader
plans      batch plans that call a model backend (generate -> critique -> refine loop, benchmark)
streaming  Structured Streaming operators (stateful stagnation monitor, streaming scorers)
"""

from critica.config import CriticWeights, LoopConfig, MetricsConfig  # noqa: F401
from critica.session import checkpoint_dir, get_session  # noqa: F401

__version__ = "0.1.0"
