"""DataFrame operators: detectors, scan, decode, policy, precheck, command replay, reports."""
