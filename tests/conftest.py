import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracehound.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=8, app="tracehound-tests")
    yield s


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


CONN_SCHEMA = "ts timestamp_ntz, id_orig_h string, id_resp_h string, id_resp_p int, orig_bytes long, resp_bytes long, duration double"
DNS_SCHEMA = "ts timestamp_ntz, id_orig_h string, query string"
WIN_SCHEMA = "`@timestamp` timestamp_ntz, event_code string, user_name string, host_name string, source_ip string, logon_type int"
