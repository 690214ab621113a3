"""Titles that are notices or meetings, and titles that look like them."""

from pyspark.sql import functions as F

from quarry.functions.nonevents import non_event

#: Titles of calendars, by the rule that makes them no event; the last are events.
TITLES = {
    "closure_notice": [
        "City Buildings Closed", "Library Closed", "Macomb Township Offices Closed", "City Hall Closed", "Offices Closed - Thanksgiving", "Library Closed: Staff Training Day", "City Offices Closed (Veterans Day)",
        "Township Offices Closed for Thanksgiving", "City Offices Closed in observance of Juneteenth", "library closed", "Village Hall Closed early", "City Offices Closed in observance of Martin Luther King Jr. Day",
        "Library Closed Today", "City Hall Closed on Christmas Eve", "City Hall Closed.", "City Hall Closed!", "City Offices Closed, Veterans Day", "City Offices Closed/Veterans Day", "City Offices Closed at Noon",
        "Library Closed (Dr. Martin Luther King, Jr. Day)", "Library Closed for Presidents' Day", "Township Hall Closed for Election", "Thanksgiving - City Offices Closed", "Veterans Day: City Offices Closed",
        "Veterans Day (City Offices Closed)", "Christmas Day – City Hall Closed", "New Year's Day - Library Closed", "College Closed", "Campus Closed - Winter Holiday Break", "Campus Closed for Spring Break",
    ],
    "closed_for_private_event": ["CLOSED FOR PRIVATE EVENT", "Closed for a private event in the evening", "closed for private events tonight at 6"],
    "suite_rental": ["Brand New - Suite Rental", "Hamilton – VIP Suite Rental", "Beck - Suite Rentals"],
    "private_event_label": ["Private Event", "Private, Event!", "DIA: Private Party", "private closed event"],
    "governance_meeting": [
        "Board of Trustees Meeting", "Macomb Township Board of Trustees Meeting", "Clinton Township Board of Trustees Regular Meeting", "Board of Trustees Meeting - 7 PM", "Recreation Board Meeting at 7pm", "City Council Meeting",
        "City Council Regular Meeting", "Planning Commission Meeting", "Zoning Board of Appeals", "Pension Board", "Dearborn Ethics Board Meeting", "Board of Review", "Historical Commission Meeting",
        "Downtown Development Authority Meeting", "Budget Hearing", "Public Hearing: Rezoning on Michigan Ave", "Regular Meeting of the Board of Trustees", "Special Meeting of the City Council", "Special Meeting - City Council",
        "Joint Meeting of City Council and Planning Commission", "Work Session: City Council", "City Council Meeting: Budget", "Planning Commission Meeting - Cancelled", "Council Meeting - Agenda",
        "Study Session: Planning Commission", "Windsor BIA Board Meeting", "HOA Meeting", "Bagley Community Council General Meeting", "October 2026 General Meeting", "CANCELED: Demolition Board of Appeals",
        "Committee of the Whole", "Waiver Committee",
    ],
    None: [
        "Case Closed: A Murder Mystery Dinner", "Bocce Barn Closing Day", "Road closed for the Holiday Parade", "Library Closed Captioning Workshop", "Office Closed-Loop Recycling Tour", "The Library Is Closed: A Drag Reading Hour",
        "Closed Session Records: An Evening of Jazz", "Friends Book Sale: Library Closed, Sale Open in the Garage", "Halloween at City Hall (City Hall closed early for Trick-or-Treat)", "Open House before the Old City Hall is closed for good",
        "Library Closed: A Drag Reading Hour", "City Hall Closed - Christmas Tree Lighting", "Library Closed for Easter Egg Hunt", "City Hall Closed for Juneteenth Celebration", "Library Closed for Weather (Virtual Storytime at 10)",
        "Juneteenth Celebration - City Offices Closed", "Friends Book Sale - Library Closed", "Drive-Thru Flu Clinic - Offices Closed", "Good Friday Fish Fry - Parish Office Closed", "Why Marygrove College Closed", "The Day the Library Closed",
        "How Detroit's Branch Libraries Closed", "The Office Closed", "After the Office Closed", "Town Hall Meeting", "Annual Meeting and Dinner", "Meet the Board of Trustees", "Board Games Cafe Meetup", "Historical Commission Open House",
        "Trunk or Treat", "The Council - Live at Lager House", "Council of Elders: Concert", "Meeting of the Minds", "Session: Live Jazz", "Work Session: Painting", "Special Meeting of the Rotary Club", "Regular Meeting of the Book Club",
        "Rotary Club Meeting", "AA Meeting", "Authority Zero", "Council House Rat Tour", "The Board", "Council Meeting Night Comedy Show", "Planning Commission Public Forum", "Town Hall with the Mayor", "Salon Suite Rental Open House",
        "Win a Suite Rental: Charity Bingo Night", "Taproom Closed for Private Event; Public Show at 9", "Not Closed for Private Event: Open Mic Returns", '"Closed for Private Event" - A Comedy Show',
        "Closed for Private Event (band) w/ The Hi-Views", "Community Blood Drive", "Senior Scams with the Macomb County Prosecutor's Office", "Office Hours with the Mayor", "Board Game Night", "THE Private Party", "", "   ", None,
        "City Hall Closed " + "for Thanksgiving " * 30, "Closed-Door Private Event", "A private event for members",
    ],
}


def test_titles(spark):
    rows = [(rule, t) for rule, ts in TITLES.items() for t in ts]
    got = spark.createDataFrame(rows, "rule string, t string").withColumn("got", non_event(F.col("t"))).where("not rule <=> got").collect()
    assert not got, [(r["t"], r["rule"], r["got"]) for r in got]
