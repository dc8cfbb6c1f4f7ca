"""Log records of fourteen kinds: three valid ones and eleven with one fault each."""

NS = 'xmlns="http://logging.apache.org/log4j/2.0/events"'
ATTRIBUTES = 'thread="main" endOfBatch="false" threadId="1" threadPriority="5"'
MILLIS = 'timeMillis="1704063600000"'
INFO = 'level="INFO"'
LOGGER = 'loggerName="TestLogger"'
INSTANT = '<Instant epochSecond="1704063600" nanoOfSecond="000000000"/>'
THROWN = (
    '<Thrown name="TestException" localizedMessage="local" message="test message">'
    "<ExtendedStackTrace>"
    '<ExtendedStackTraceItem class="A" method="m1" file="A.java" line="123" exact="false"'
    ' location="Test.jar" version="1.0.0" />'
    '<ExtendedStackTraceItem class="A" method="m2" file="A.java" line="456" exact="true"'
    ' location="Test.jar" version="1.0.0" />'
    "</ExtendedStackTrace></Thrown>"
)


def record(body, *attributes, tag="Event"):
    head = " ".join([NS, *attributes, ATTRIBUTES])
    return f"  <{tag} {head}>\n    {body}\n  </{tag}>"


def message(text):
    return f"<Message>{text}</Message>"


ALL = (MILLIS, INFO, LOGGER)
RECORDS = [
    record(INSTANT + message("all tags") + THROWN, *ALL),
    record(message("no instant"), *ALL),
    record('<Instant nanoOfSecond="0"/>' + message("m"), *ALL),
    record('<Instant epochSecond="1704063600"/>' + message("m"), *ALL),
    record('<Instant epochSecond="10000000000000" nanoOfSecond="0"/>' + message("m"), *ALL),
    record(message("m"), INFO, LOGGER),
    record(message("m"), 'timeMillis="10000000000000000"', INFO, LOGGER),
    record(INSTANT + message("m"), MILLIS, INFO),
    record(INSTANT + message("m"), MILLIS, LOGGER),
    record(INSTANT + message("m"), MILLIS, 'level="CRITICAL"', LOGGER),
    record(INSTANT + "<!-- " + message("hidden") + " -->", *ALL),
    record(INSTANT + message("m"), *ALL, tag="NoEvent"),
    record(message("broken") + "\n    <Invalid tag ...", *ALL),
    record(INSTANT + message("after the broken one"), *ALL),
]
