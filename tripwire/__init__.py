"""tripwire — Spark-native screening of message text for hidden or injected
instructions, and of payments against spend limits and a recipient allowlist.

Everything is a DataFrame transformation: scanning is a narrow projection, spend windows and command-log replay shuffle once by their key.
"""

from tripwire.params import ScanParams, PolicyParams
from tripwire.operators.scan import (findings_table, python_detector, register_detector, register_pattern, scan_messages,
                                     unregister_detector, unregister_pattern)

__all__ = ["ScanParams", "PolicyParams", "scan_messages", "findings_table",
           "register_detector", "unregister_detector", "register_pattern", "unregister_pattern", "python_detector"]
